"""Ranking and similarity over a corpus, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import ScorePolicy, SearchPolicy
from ..functions.text import pairs_of, search_terms, statement_key
from .stages import written


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return rows.select(F.col(id_col).alias("id"), F.explode(search_terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def explicit_term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): search terms and plain words of two characters or more, each as often as the one or the other."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    plain = rows.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return term_counts(rows, id_col, text_col).unionByName(plain).groupBy("id", "term").agg(F.max("tf").alias("tf"))


#: Pairs whose products a task holds at a time.
CELLS = 1 << 17
_TERM_CELLS = 1 << 22  # of documents by terms, that are held as a matrix at a time
_FAR = 1e18  # stands for what is not finite among millionths


def _whole(x: np.ndarray) -> np.ndarray:
    """x as whole numbers, halves away from zero."""
    whole = np.trunc(x)
    return whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)


def _best(like: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k largest, with what ties with the last of them up to k in the order of columns; -inf is
    none."""
    bar = np.partition(like, like.shape[1] - k, axis=1)[:, [like.shape[1] - k]] if like.shape[1] > k else np.full((len(like), 1), -np.inf)
    level = like == bar
    return np.nonzero(((like > bar) | (level & (np.cumsum(level, axis=1) <= k))) & (like > -np.inf))


def bm25(queries: DataFrame, docs: DataFrame, policy: SearchPolicy = SearchPolicy(), longer_first: bool = False, most: int | None = None, block: int = 256, slice_rows: int = 4096) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, text) and docs(id, text): each query's rarest present terms,
    Okapi weights, ranks by score to six digits and then id; with most only ranks up to it. With longer_first terms of
    equal frequency go by length before they go by themselves. Ids of docs tell them apart.

    Documents are cut into terms once; what no query holds becomes one count a document as it is cut, so that the exchange
    carries postings of query terms only. Postings and terms then meet by blocks of queries and slices of docs, where all
    scores are one product of matrices; with most only what may be among a query's best leaves a task."""
    asked = written(queries.select("query_id", F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term")), "search-asked")
    words = written(asked.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "search-words")
    sightings = docs.select("id", F.explode_outer(search_terms(F.col("text"))).alias("term")).join(words, "term", "left")
    postings = written(sightings.groupBy("id", "code").agg(F.count("term").alias("tf")), "search-postings")
    found = postings.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("df"))
    ties = [F.desc(F.length("term")), "term"] if longer_first else ["term"]
    rarest = Window.partitionBy("query_id").orderBy("df", *ties)
    n = docs.count()
    corpus = postings.agg((F.sum("tf") / n).alias("mean"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(words, "term").join(found, "code").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= policy.term_limit)
    terms = terms.join(F.broadcast(corpus)).select("query_id", "code", idf.alias("idf"), "mean")
    query_kind, kind = _kinds(queries, docs)

    def match(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "id": held["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        held = held.sort_by("id")
        query, doc = (t[c].combine_chunks().dictionary_encode() for t, c in ((asked, "query_id"), (held, "id")))
        row, column = (x.indices.to_numpy() for x in (doc, query))
        tf = held["tf"].to_numpy().astype(np.float64)
        norm = policy.k1 * (1 - policy.b + policy.b * np.bincount(row, tf) / max(1.0, asked["mean"][0].as_py()))
        codes, term = np.unique(asked["code"].to_numpy(), return_inverse=True)
        idf, holds = np.zeros(len(codes)), np.zeros((len(codes), len(query.dictionary)))
        idf[term], holds[term, column] = asked["idf"].to_numpy(), 1
        code = pc.fill_null(held["code"], -1).to_numpy()
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = np.flatnonzero(codes[at] == code)
        row, at, tf = row[known], at[known], tf[known]
        weight = idf[at] * tf * (policy.k1 + 1) / (tf + norm[row])
        like, step = np.empty((len(query.dictionary), len(doc.dictionary))), max(1, _TERM_CELLS // len(codes))
        for low in range(0, like.shape[1], step):
            some = slice(*np.searchsorted(row, (low, low + step)))
            part = np.zeros((min(step, like.shape[1] - low), len(codes)))
            part[row[some] - low, at[some]] = weight[some]
            like[:, low : low + step] = (part @ holds).T
        score = np.where(like > 0, _whole(like * 1e6), -np.inf)
        i, j = _best(score, like.shape[1] if most is None else most)
        return pa.table({"query_id": query.dictionary.take(pa.array(i)), "id": doc.dictionary.take(pa.array(j)), "score": score[i, j] / 1e6})

    blocks, slices = max(1, -(-queries.count() // block)), max(1, -(-n // slice_rows))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # a small exchange means much work here, so that its parts are not put together
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = lambda rows: rows.repartition(tasks, "block", "slice")
    left = dealt(terms.withColumn("block", part("query_id", blocks)).withColumn("slice", every(slices)))
    right = dealt(postings.where("id IS NOT NULL").withColumn("slice", part("id", slices)).withColumn("block", every(blocks)))
    scored = _met(left, right, match, f"query_id {query_kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranks = scored.withColumn("rank", F.row_number().over(order))
    return ranks if most is None else ranks.where(F.col("rank") <= most)


def _vectors(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """The lengths of a table's vectors, -1 for null ones and those with null components, and the vectors."""
    lists = table[name].combine_chunks()
    width = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(len(width)), np.maximum(width, 0))
        width[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return width, lists


def _products(asked: pa.Table, held: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of docs, millionths of their cosine) in parts of some CELLS pairs; what is not a number is
    2 * _FAR, so that it is the largest, and no pair has vectors of two lengths. Docs keep the order of held.

    The sums are those from the first component to the last, in double precision: a product of matrices gives them but for
    the last digits, and where these could tell on the millionths, they are summed again."""
    (qw, ql), (dw, dl) = _vectors(asked, "q"), _vectors(held, "v")
    norm = asked["norm"].to_numpy()
    for w in np.unique(qw[qw > 0]):
        rows, cols = np.flatnonzero(qw == w), np.flatnonzero(dw == w)
        if not len(cols):
            continue
        take = lambda lists, at: lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)
        q, d = take(ql, rows), np.ascontiguousarray(take(dl, cols).T)
        with np.errstate(invalid="ignore", over="ignore"):
            doubt = (4 * w + 8) * np.finfo(float).eps * 1e6 * np.sqrt(np.square(d).sum(axis=0))  # what two orders of a sum differ by at most
        far = np.flatnonzero(~(doubt < 0.01))
        near = d.copy() if len(far) else d
        near[:, far], doubt[far] = 0, 0
        step = max(1, CELLS // len(cols))
        for low in range(0, len(rows), step):
            part, length = q[low : low + step], norm[rows[low : low + step], None]
            like = part @ near
            like /= length
            like *= 1e6
            size = np.abs(like)
            whole = np.trunc(size)
            size -= whole
            size -= 0.5
            i, j = np.nonzero(np.abs(size) <= doubt)
            whole += size >= 0
            like = np.copysign(whole, like) + 0.0
            like[i, j] = _millionths(part[i].T, d[:, j], length[i, 0])
            like[:, far] = _millionths(part.T[:, :, None], d[:, None, far], length)
            yield rows[low : low + step], cols, like


def _millionths(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Products of a and b summed along the first axis in its order, by length."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    with np.errstate(invalid="ignore", over="ignore"):
        for x, y in zip(a, b, strict=True):
            out += x * y
        out = np.clip(_whole(out / length * 1e6), -_FAR, _FAR)
    out[np.isnan(out)] = 2 * _FAR
    return out


def _similarity(millionths: np.ndarray) -> np.ndarray:
    out = millionths / 1e6
    out[millionths >= _FAR], out[millionths <= -_FAR], out[millionths > _FAR] = np.inf, -np.inf, np.nan
    return out


def _blocks(queries: DataFrame, docs: DataFrame, block: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """The stated queries and all docs, to meet by (block, slice): a query stands in one block of about `block` and a doc in
    one slice of about slice_rows, both by hash, and every block meets every slice once, so that neither side is
    broadcast and no task holds all of either. Null, zero and non-finite queries are left out."""
    return _dealt(queries, docs, *(max(1, -(-rows.count() // size)) for rows, size in ((queries, block), (docs, slice_rows))))


def _dealt(queries: DataFrame, docs: DataFrame, blocks: int, slices: int) -> tuple[DataFrame, DataFrame]:
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    asked = queries.select("query_id", F.col("vector").alias("q"), F.sqrt(product("vector", "vector")).alias("norm"), *[c for c in queries.columns if c not in ("query_id", "vector")])
    asked = asked.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", part("query_id", blocks)).withColumn("slice", every(slices))
    right = docs.select("id", F.col("vector").alias("v"), part("id", slices).alias("slice")).withColumn("block", every(blocks))
    return left, right


def _met(left: DataFrame, right: DataFrame, match: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(match, schema)


Worth = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Pairs of a cell at least, and cells for each of the session's cores, so long as they are no larger.
CELL_PAIRS, CELLS_EACH = 1 << 18, 8
#: Rows of counts that a task adds up at a time.
HISTOGRAMS = 1 << 14


def _cut(asked: int, held: int, block: int, slice_rows: int, cores: int) -> tuple[int, int]:
    """Blocks and slices of so many queries and docs, of at most about block and slice_rows: as many as keep all cores busy
    and no more, in the ratio that copies the fewest rows, so that what crosses an exchange grows with the tables and not
    with the pairs for as long as the two bounds allow."""
    cells = max(1, min(CELLS_EACH * cores, -(-asked * held // CELL_PAIRS)))
    blocks = max(1, -(-asked // block), round((cells * asked / max(1, held)) ** 0.5))
    return blocks, max(1, -(-held // slice_rows), -(-cells // blocks))


def _in_cells(queries: DataFrame, docs: DataFrame, blocks: int, slices: int, match: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What match yields for the queries and docs of every cell, a block and a slice as those of `_blocks`. Results leave a
    task as they are made."""
    left, right = _dealt(queries, docs, blocks, slices)
    cell = (F.col("block") * slices + F.col("slice")).alias("cell")
    drop = lambda rows: rows.select("*", cell).drop("block", "slice")
    rows = drop(left).unionByName(drop(right), allowMissingColumns=True).repartition(blocks * slices, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        asks = pc.is_valid(table["norm"])
        yield from match(table.filter(asks), table.filter(pc.invert(asks)).sort_by("id"))

    return rows.groupBy("cell").applyInArrow(run, schema)


def _kinds(queries: DataFrame, docs: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()


def cosine_top(queries: DataFrame, docs: DataFrame, k: int, apart: bool = False, block: int = 4096, slice_rows: int = 8192) -> DataFrame:
    """(query_id, id, similarity, rank): of every query(query_id, vector) the k nearest docs(id, vector) by the dot product
    with the normalised query, summed in double precision, to six digits; ties to the smaller id. With apart a doc of the
    query's own id is left out. Null, zero and non-finite queries find nothing; a doc whose vector is null, has a null
    component or another length than the query's comes last, with a null similarity.

    Every pair is computed, in blocks (`_blocks`); of a block and a slice only each query's k best, with what ties with the
    last of them up to k, leave the task."""
    left, right = _blocks(queries, docs, block, slice_rows)
    query_kind, kind = _kinds(queries, docs)

    def match(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("id")
        parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        own, ids = (t[c].to_numpy() for t, c in ((asked, "query_id"), (held, "id")))
        (qw, _), (dw, _) = _vectors(asked, "q"), _vectors(held, "v")

        def best(rows: np.ndarray, cols: np.ndarray, like: np.ndarray) -> None:
            if apart:
                like[own[rows][:, None] == ids[cols]] = -np.inf
            i, j = _best(like, k)
            parts.append((rows[i], cols[j], like[i, j]))

        for rows, cols, like in _products(asked, held):
            best(rows, cols, like)
        i, j, like = (np.concatenate(c) for c in zip(*parts, strict=True))
        similarity, unmet = pa.array(_similarity(like)), []
        for w in np.unique(qw):
            bad = np.flatnonzero(dw != w)
            step = max(1, CELLS // max(1, len(bad)))
            some = np.flatnonzero(qw == w) if len(bad) else np.zeros(0, np.int64)
            for rows in (some[low : low + step] for low in range(0, len(some), step)):
                free = own[rows][:, None] != ids[bad] if apart else np.ones((len(rows), len(bad)), bool)
                a, b = np.nonzero(free & (np.cumsum(free, axis=1) <= k))
                unmet.append((rows[a], bad[b]))
        if unmet:
            a, b = (np.concatenate(c) for c in zip(*unmet, strict=True))
            i, j, similarity = np.concatenate([i, a]), np.concatenate([j, b]), pa.concat_arrays([similarity, pa.nulls(len(a), pa.float64())])
        return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "id": held["id"].take(pa.array(j)), "similarity": similarity})

    return top_per_query(_met(left, right, match, f"query_id {query_kind}, id {kind}, similarity double"), "similarity", k)


def cosine_lift(queries: DataFrame, docs: DataFrame, policy: ScorePolicy = ScorePolicy(), block: int = 16384, slice_rows: int = 16384, bins: int = 256, worth: Worth | None = None) -> DataFrame:
    """(query_id, id, similarity, lift, leads) of every query(query_id, vector) with every doc(id, vector): the similarity of
    `cosine_top`, its distance from the query's upper median (in a scope of few docs from the typical one) and whether the doc
    is the query's nearest, ties to the smaller id. Query ids are distinct.

    The median is exact: tasks count each query's similarities by ranges of millionths, and the range that holds the middle
    is cut again until it is one value, so that only counts cross an exchange, those of a query and a cell (`_in_cells`) as
    one row. Pairs are computed anew each time and are never written. With worth only the pairs for which it holds are
    returned: it is given arrays of ids of queries (down) and docs (across), which are numbers, null ones 0, lifts, NaN where
    there is none, and leads."""
    query_kind, kind = _kinds(queries, docs)
    n_queries, n_docs = queries.count(), docs.count()
    blocks, slices = _cut(n_queries, n_docs, block, slice_rows, queries.sparkSession.sparkContext.defaultParallelism)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = docs.select(F.sqrt(square).alias("n")).where("n < double('infinity')").agg(F.max("n")).first()[0] or 0.0
    low, wide = -int(longest * 1e6) - 2, 2 * int(longest * 1e6) + 5
    state = queries.select("query_id", "vector", F.lit(low).cast("long").alias("low"))

    def counted(width: int) -> Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]:
        def match(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
            n, start = asked.num_rows, asked["low"].to_numpy().astype(np.float64)
            hits, known, top, first = np.zeros((n, bins + 1), np.int64), np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, np.int64)
            for rows, cols, like in _products(asked, held):
                known[rows] += like.shape[1]
                one = like.argmax(axis=1)
                top[rows], first[rows] = like[np.arange(len(rows)), one], cols[one]
                like -= start[rows, None]
                like /= width
                at = np.clip(np.floor(like, out=like), -1, bins, out=like).astype(np.int64)  # what lies above all ranges counts too
                at += np.arange(1, len(rows) * (bins + 2), bins + 2)[:, None]
                hits[rows] += np.bincount(at.ravel(), minlength=len(rows) * (bins + 2)).reshape(len(rows), bins + 2)[:, 1:]
            met = np.flatnonzero(known)
            if len(met):
                where, small = pa.array(met), hits[met].astype(np.min_scalar_type(hits.max()))
                packed = pa.array([x.tobytes() for x in small], pa.binary())
                yield _batch(query_id=asked["query_id"].take(where), low=asked["low"].take(where), hits=packed, known=known[met], top=top[met], first=held["id"].take(pa.array(first[met])))

        return match

    def summed(width: int) -> Callable[[pa.Table], pa.Table]:
        def run(found: pa.Table) -> pa.Table:
            found = found.sort_by([("query_id", "ascending"), ("top", "descending"), ("first", "ascending")])
            place = pc.rank(found["query_id"], sort_keys="ascending", tiebreaker="dense").to_numpy()
            begin = np.flatnonzero(np.diff(place, prepend=0))
            hits = np.stack([np.frombuffer(x.as_py(), f"u{len(x.as_py()) // (bins + 1)}").astype(np.int64) for x in found["hits"]])
            hits = np.add.reduceat(hits, begin, axis=0)[:, ::-1].cumsum(axis=1)[:, ::-1]  # in a range and above
            known = np.add.reduceat(found["known"].to_numpy(), begin)
            at = (hits >= -(-known // 2)[:, None]).sum(axis=1) - 1
            where = pa.array(begin)
            low = pa.array(found["low"].to_numpy()[begin] + at * width, mask=at < 0)
            return pa.table({"query_id": found["query_id"].take(where), "low": low, "best": found["first"].take(where)})

        return run

    best = None
    while True:
        width = max(1, -(-wide // bins))
        found = _in_cells(state, docs, blocks, slices, counted(width), f"query_id {query_kind}, low long, hits binary, known long, top double, first {kind}")
        parts = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries * slices // HISTOGRAMS))))
        found = written(found.groupBy(parts.alias("part")).applyInArrow(summed(width), f"query_id {query_kind}, low long, best {kind}"), "lift-ranges")
        best = best or found.select("query_id", "best")
        state = queries.join(found.where("low IS NOT NULL").select("query_id", "low"), "query_id").select("query_id", "vector", "low")
        if width == 1:
            break
        wide = width
    middle = F.col("low").cast("double") if n_docs >= policy.median_scope else F.lit(policy.typical_median * 1e6)
    asked = queries.select("query_id", "vector").join(best, "query_id", "left").join(found.select("query_id", "low"), "query_id", "left").select("query_id", "vector", "best", middle.alias("middle"))

    def lifted(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        middle, ids, known = asked["middle"].to_numpy() / 1e6, held["id"].combine_chunks(), {}
        place = pc.index_in(ids, value_set=ids).to_numpy(zero_copy_only=False)
        leader = pc.if_else(pc.is_valid(asked["best"]), pc.index_in(asked["best"], value_set=ids), None).fill_null(-1).to_numpy()
        if worth:
            known = {"down": asked["query_id"].to_numpy()[:, None], "across": ids.fill_null(0).to_numpy()}

        def pairs(rows: np.ndarray, cols: np.ndarray, similarity: np.ndarray, lift: np.ndarray, none: bool) -> pa.RecordBatch:
            leads = place[cols] == leader[rows, None]
            at = np.flatnonzero(worth(known["down"][rows], known["across"][cols], lift, leads)) if worth else np.arange(lift.size)
            i, j, similarity, lift = rows[at // len(cols)], cols[at % len(cols)], similarity.ravel()[at], lift.ravel()[at]
            unknown = np.full(len(at), none)
            return _batch(query_id=asked["query_id"].take(pa.array(i)), id=ids.take(pa.array(j)), similarity=pa.array(similarity, mask=unknown), lift=pa.array(lift, mask=unknown | np.isnan(middle[i])), leads=leads.ravel()[at])

        for rows, cols, like in _products(asked, held):
            similarity = _similarity(like)
            yield pairs(rows, cols, similarity, _whole((similarity - middle[rows, None]) * 1e7) / 1e7, False)
        (qw, _), (dw, _) = _vectors(asked, "q"), _vectors(held, "v")
        for w in np.unique(qw):
            cols, some = np.flatnonzero(dw != w), np.flatnonzero(qw == w)
            step = max(1, CELLS // max(1, len(cols)))
            for rows in (some[low : low + step] for low in range(0, len(some) if len(cols) else 0, step)):
                nothing = np.full((len(rows), len(cols)), np.nan)
                yield pairs(rows, cols, nothing, nothing, True)

    return _in_cells(asked, docs, blocks, slices, lifted, f"query_id {query_kind}, id {kind}, similarity double, lift double, leads boolean")


def _batch(**columns: pa.Array | pa.ChunkedArray | np.ndarray) -> pa.RecordBatch:
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()]
    return pa.RecordBatch.from_arrays(flat, list(columns))


def top_per_query(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best of each query with their rank; the limit runs before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, policy: SearchPolicy = SearchPolicy()) -> DataFrame:
    """(query_id, id, rrf): reciprocal rank fusion of two rankings, either of which may lack a row."""
    part = lambda c: F.coalesce(1 / (policy.fusion_offset + F.col(c)), F.lit(0.0))
    both = lexical.select("query_id", "id", F.col("rank").alias("l")).join(semantic.select("query_id", "id", F.col("rank").alias("s")), ["query_id", "id"], "full")
    return both.select("query_id", "id", F.round(part("l") + part("s"), 9).alias("rrf"))


def near_duplicates(rows: DataFrame, keys: list[str], threshold: float, block: int = 512) -> DataFrame:
    """(left_id, right_id, similarity): pairs id < id of rows(id, vector, *keys) with equal keys and a dot product of
    threshold or more. Null keys and vectors pair with nothing.

    A key's rows are dealt into blocks of about `block` by hash of their id; every two blocks meet once in a task, whatever
    a key holds, as a product of matrices, and only pairs that count leave it."""
    known = rows.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"), F.to_json(F.struct(*keys)).alias("key"), *keys).dropna(subset=keys)
    sizes = known.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = known.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vector")

    def match(table: pa.Table) -> pa.Table:
        ids, own = table["id"].combine_chunks(), table["own"].to_numpy()
        lists = table["vector"].combine_chunks()
        width = lists.value_lengths().to_numpy()
        left, right, dot = [], [], []
        for w in np.unique(width):  # vectors of one length meet
            some = np.flatnonzero(width == w)
            x = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), w)
            like = x @ x.T
            good = np.triu(np.ones(like.shape, bool), 1) & (like >= threshold - 1e-6)
            if own.min() != own.max():
                good &= own[some][:, None] != own[some]
            a, b = np.nonzero(good)
            left.append(some[a])
            right.append(some[b])
            dot.append(like[a, b])
        a, b, d = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((left, np.int64), (right, np.int64), (dot, float)))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "dot": d})

    kind = rows.schema["id"].dataType.simpleString()
    pairs = dealt.groupBy("key", "i", "j").applyInArrow(match, f"a {kind}, b {kind}, dot double").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), F.round("dot", 6).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold)


def bigram_neighbours(items: DataFrame, memories: DataFrame, least: float = 0.08, k: int = 5, block: int = 64, slice_rows: int = 4096) -> DataFrame:
    """(item_id, memory_id, similarity, rank): Jaccard similarity over the character pairs of statement keys, of those
    at least alike the k most similar, ties to the smaller id.

    At so low a bar hardly any pair of rows can be ruled out beforehand, so the items meet all memories in blocks: some
    `block` items and some slice_rows memories, both by hash, in a task at a time, where what they share comes from one
    product of matrices. Only what may be among an item's k best leaves it. Null and empty keys have no neighbours."""
    blocks, slices = (max(1, -(-rows.count() // size)) for rows, size in ((items, block), (memories, slice_rows)))
    codes = F.transform(F.array_distinct(pairs_of(statement_key(F.coalesce(F.col("text"), F.lit(""))))), lambda g: F.xxhash64(g))
    cut = lambda rows, name: rows.select(F.col(name).alias("id"), codes.alias("codes"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cut(items, "item_id").withColumn("block", part(blocks)).withColumn("slice", every(slices))
    right = cut(memories, "memory_id").withColumn("slice", part(slices)).withColumn("block", every(blocks))

    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = table["codes"].combine_chunks()
        return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()

    def match(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and held.num_rows:
            (a, ln), (b, rn) = flat(asked), flat(held)
            known, column = np.unique(a, return_inverse=True)
            own = np.zeros((len(ln), len(known)), np.float32)
            own[np.repeat(np.arange(len(ln)), ln), column] = 1
            at = np.minimum(np.searchsorted(known, b), len(known) - 1)
            row, ends = np.repeat(np.arange(len(rn)), rn), np.cumsum(rn)
            common = np.zeros((len(ln), len(rn)), np.int64)
            for low in range(0, len(rn), 512):
                high = min(low + 512, len(rn))
                some = slice(int(ends[low] - rn[low]), int(ends[high - 1]))
                hit = known[at[some]] == b[some]
                there = np.zeros((high - low, len(known)), np.float32)
                there[row[some][hit] - low, at[some][hit]] = 1
                common[:, low:high] = own @ there.T
            like = common / np.maximum(ln[:, None] + rn - common, 1)
            for i, mine in enumerate(like):
                # rounding may make neighbours of what lies within a unit of the last digit kept
                bar = max(least, np.partition(mine, -k)[-k] if len(mine) >= k else 0) - 1e-6
                found += [(i, j, common[i, j], ln[i], rn[j]) for j in np.flatnonzero(mine >= bar)]
        i, j, c, m, n = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 5))
        return pa.table({"item_id": asked["id"].take(pa.array(i)), "memory_id": held["id"].take(pa.array(j)), "c": c, "ln": m, "rn": n})

    kinds = [rows.schema[name].dataType.simpleString() for rows, name in ((items, "item_id"), (memories, "memory_id"))]
    shared = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(match, f"item_id {kinds[0]}, memory_id {kinds[1]}, c long, ln long, rn long")
    scored = shared.select("item_id", "memory_id", F.round(F.col("c") / (F.col("ln") + F.col("rn") - F.col("c")), 6).alias("similarity")).where(F.col("similarity") >= least)
    order = Window.partitionBy("item_id").orderBy(F.desc("similarity"), "memory_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
