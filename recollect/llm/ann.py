"""Nearest neighbours by multi-index hashing: learned rotated binary codes, cut into substrings that are indexed each.

Two codes within Hamming radius r differ in at most r // SUBSTRINGS bits of one of their substrings (pigeonhole), so
probing every substring's buckets up to that many bits finds every code within r. What is found is ranked by exact
distance of the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize

BITS, SUBSTRINGS = 64, 4
WIDTH = BITS // SUBSTRINGS
#: The codes and the radius are learned from at most so many rows, of which so many serve as queries; seed of both.
SAMPLE_ROWS, SAMPLE_QUERIES, SEED = 20_000, 200, 17
#: Share of the sample's neighbours that the radius takes in.
COVERED = 0.97
#: Index rows and query rows that meet in one task at a time.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 1_024
_ONES = np.array([bin(i).count("1") for i in range(1 << WIDTH)], np.uint8)


class Codes:
    """Directions learned by iterative quantisation (a rotation that brings principal axes near the signs), with random
    directions after them where the vectors have fewer dimensions than bits."""

    def __init__(self, sample: np.ndarray, steps: int = 30):
        rng = np.random.default_rng(SEED)
        self.mean = sample.mean(0)
        x = sample - self.mean
        k = min(BITS, x.shape[1])
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :k]
        v = x @ axes
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        self.directions = np.hstack([axes @ turn, rng.standard_normal((x.shape[1], BITS - k))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Substrings, one column of uint16 each."""
        bits = np.packbits((x - self.mean) @ self.directions > 0, axis=1)
        return bits.reshape(len(x), SUBSTRINGS, WIDTH // 8).astype(np.uint16) @ np.array([256, 1], np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair of rows of a and b, bits that differ in each substring."""
    return _ONES[a[:, None, :] ^ b[None, :, :]]


def distances(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - a) ** 2).sum(1))


def _radius(codes: Codes, sample: np.ndarray, k: int) -> int:
    """The Hamming radius that holds COVERED of the k nearest in the sample; neighbours there are further apart than in
    the whole table, so the radius errs to the large side."""
    found = []
    substrings = codes(sample)
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        d = distances(sample[i], sample)
        d[i] = math.inf
        near = np.argsort(d)[: min(k, len(sample) - 1)]
        found += hamming(substrings[i : i + 1], substrings[near]).sum(2, dtype=int).ravel().tolist()
    return min(int(np.quantile(found, COVERED)) + 1, BITS) if found else BITS


def _classes(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(key, ids, vector): one row per distinct vector with its k + 1 smallest ids, which is all that any query needs.

    Repeated ids are one before they are ranked. That takes an exchange of keys and ids, in which every id of a vector
    that a third of the rows share goes its own way; the ranking limit then runs before the exchange by key."""
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["key", "vec_id"])
    w = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    return few.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(key, vec_id, vector) of the rows that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.md5(F.array_join(v.cast("array<string>"), ",")).alias("key"), F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def nearest(vectors: DataFrame, k: int = 10, query_modulus: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by query_modulus the k nearest found among all
    others by Euclidean distance, ties to the smaller id.

    Rows with null, zero or non-finite vectors take no part; vectors of different lengths have no distance and meet in
    no search, and those of another length than most are searched whole, by blocks. Equal vectors are searched once
    and their results shared; repeated ids count once. A query that finds fewer than k within the
    radius is searched again with the full radius, which compares it with every code. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    classes = materialize(_classes(vectors, id_col, vector_col, k), "ann-classes")
    lengths = classes.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    most = F.size("vector") == lengths["n"]
    sample = np.array([r["vector"] for r in classes.where(most).orderBy(F.md5(F.col("key"))).limit(SAMPLE_ROWS).select("vector").collect()])
    codes = Codes(sample)
    radius = _radius(codes, sample, k)

    @F.pandas_udf("array<int>")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series(list(codes(np.array(x.to_list())).astype(np.int32)))

    index = materialize(classes.where(most).withColumn("code", code("vector")), "ann-index")
    # a code of zeros: all other lengths share one bucket and are told apart by their length
    others = materialize(classes.where(~most).withColumn("code", F.array_repeat(F.lit(0), SUBSTRINGS)), "ann-others")
    query_ids = materialize(usable(vectors, id_col, vector_col).where(F.col("vec_id") % query_modulus == 0).select("key", F.col("vec_id").alias("query_id")).distinct(), "ann-queries")
    asked = materialize(index.join(query_ids.select("key").distinct(), "key", "left_semi"), "ann-asked")
    found = materialize(_search(index, asked, radius, k), "ann-found")
    short = query_ids.join(index.select("key"), "key", "left_semi").join(found.groupBy("key").count(), "key", "left").where(F.coalesce("count", F.lit(0)) < k + 1).select("key").distinct()
    short = materialize(short, "ann-short")
    if not short.isEmpty() and radius < BITS:
        again = _search(index, asked.join(short, "key", "left_semi"), BITS, k)
        found = found.join(short, "key", "left_anti").unionByName(again)
    if not others.isEmpty():
        rest = materialize(others.join(query_ids.select("key").distinct(), "key", "left_semi"), "ann-asked")
        found = found.unionByName(_search(others, rest, 0, k))
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # an id with two vectors counts once, at the nearer
    rows = query_ids.join(found, "key").where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(index: DataFrame, asked: DataFrame, radius: int, k: int) -> DataFrame:
    """(key, vec_id, score): per asked vector its k + 1 nearest ids, itself among them.

    Every index row goes under each of its substrings, cut by the substring's top bits; an asked vector goes to the
    cells that its probes can reach. Cells are cut further into blocks of bounded size, so no hot cell meets in one
    task, and a block returns k + 1 rows per asked vector at most."""
    reach, top = radius // SUBSTRINGS, 4
    n_index, n_asked = index.count(), asked.count()
    salts, chunks = max(1, math.ceil(n_index / (INDEX_BLOCK * 4))), max(1, math.ceil(n_asked / QUERY_BLOCK))
    places = F.array(*[F.struct(F.lit(j).alias("sub"), F.shiftright(F.col("code")[j], WIDTH - top).alias("top")) for j in range(SUBSTRINGS)])
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    # a cell is as large as its share of the codes, whatever the data: blocks bound it
    stored = index.select("ids", "vector", "code", salt.alias("salt"), F.explode(places).alias("p")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    stored = stored.select(F.size("vector").alias("length"), F.col("p.sub").alias("sub"), F.col("p.top").alias("top"), "salt", "chunk", "ids", "vector", "code")
    cells = F.expr(f"filter(sequence(0, {(1 << top) - 1}), t -> bit_count(t ^ p.top) <= {reach})")
    probes = asked.select("key", "vector", "code", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(places).alias("p"))
    probes = probes.withColumn("top", F.explode(cells)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(F.size("vector").alias("length"), F.col("p.sub").alias("sub"), "top", "salt", "chunk", "key", "vector", "code")

    def block(group: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            sub = int(group[1])
            x, c = np.array(rows["vector"].to_list()), np.array(rows["code"].to_list(), np.uint16)
            a, d = np.array(queries["vector"].to_list()), np.array(queries["code"].to_list(), np.uint16)
            ids = rows["ids"].to_list()
            buckets, member = np.unique(c[:, sub], return_inverse=True)
            for i, key in enumerate(queries["key"]):
                at = np.flatnonzero((_ONES[buckets ^ d[i, sub]] <= reach)[member])
                apart = _ONES[c[at] ^ d[i]]
                # a pair is taken under the first substring that finds it
                at = at[(apart.sum(1, dtype=int) <= radius) & ~(apart[:, :sub] <= reach).any(1)]
                if not len(at):
                    continue
                score = distances(a[i], x[at])
                some, best = k + 1, {}
                while True:  # an id may stand under several vectors, so that more of them are needed
                    keep = score <= np.partition(score, some - 1)[some - 1] if some < len(at) else np.ones(len(at), bool)
                    for s, v in sorted((float(s), int(v)) for r, s in zip(at[keep], score[keep], strict=True) for v in ids[r]):
                        best.setdefault(v, s)
                    if len(best) > k or keep.all():
                        break
                    some, best = some * 2, {}
                out += [(key, v, s) for v, s in list(best.items())[: k + 1]]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    by = ("length", "sub", "top", "salt", "chunk")
    near = stored.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(block, "key string, vec_id long, score double")
    w = Window.partitionBy("key").orderBy("score", "vec_id")
    near = near.groupBy("key", "vec_id").agg(F.min("score").alias("score"))
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")
