"""Merkle manifest of a dataset: a tree of digests per group and one over the groups, with a proof for every row.

Leaves are numbered by one range exchange. Parents then grow by events: a partial parent gathers the digests of its
children with their places until it has as many as its arity, which follows from the tree's size; it is emitted as a
child of the next level at once, and so on upwards. Tasks do so over the runs of leaves that they read; what a task
cannot finish, a few partial parents on the edges of its runs, goes by combineByKey to where the rest of a band of levels
meets, band by band. Each finished parent leaves a link to its children; proofs run down those links, band by band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .worker import frugal
from .workspace import materialize, scratch

#: Levels that meet in one group of the later steps: with two children each, 4,096 nodes at most.
BAND_NODES = 4096
ROW_BITS = 33  # of monotonically_increasing_id below the task's number
DIGEST = 32
_LINKS = "tree string, n long, level int, place long, places array<long>, digests array<binary>, whole boolean"
_LINK_SCHEMA = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("places", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("whole", pa.bool_())])


def joined(digests: Iterable[bytes]) -> bytes:
    """The digest over digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_digest(*values: Column) -> Column:
    """The digest of values: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def nodes_at(n: int, level: int, arity: int) -> int:
    return -(-n // arity**level)


def height(n: int, arity: int) -> int:
    level = 0
    while nodes_at(n, level, arity) > 1:
        level += 1
    return level


class Frontier:
    """Partial parents by (tree, level, place), each with its children's digests by place, and the links finished."""

    def __init__(self, arity: int):
        self.arity, self.open, self.links = arity, {}, []

    def take(self, tree: str, n: int, level: int, place: int, digest: bytes) -> None:
        """A node has come: it and every ancestor that it completes."""
        while (wide := nodes_at(n, level, self.arity)) > 1:
            parent = place // self.arity
            children = self.open.setdefault((tree, level + 1, parent), (n, {}))[1]
            children[place] = digest
            if len(children) < min(self.arity, wide - parent * self.arity):
                return
            del self.open[tree, level + 1, parent]
            digests = [d for _, d in sorted(children.items())]
            level, place, digest = level + 1, parent, joined(digests)
            self.links.append((tree, n, level, place, None, digests, True))

    def partial(self, tree: str, n: int, level: int, places: list[int], digests: list[bytes]) -> Frontier:
        """A partial parent at a level has come from elsewhere: its children are taken here."""
        for place, digest in zip(places, digests, strict=True):
            self.take(tree, n, level - 1, place, digest)
        return self

    def merge(self, other: Frontier) -> Frontier:
        self.links += other.links
        for (tree, level, _), (n, children) in other.open.items():
            self.partial(tree, n, level, list(children), list(children.values()))
        return self

    def rows(self) -> Iterator[tuple]:
        yield from self.links
        for (tree, level, place), (n, children) in self.open.items():
            yield tree, n, level, place, list(children), list(children.values()), False


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with the place of each in its tree, from 0 by the order, and the tree's size n. Rows that are equal in the
    order are told apart by where they were written, so that no key gathers in one task."""
    spread = "spread_"
    rows = materialize(rows.withColumn(spread, F.monotonically_increasing_id()), f"{name}-rows")
    by = ["tree", *order, spread]
    dealt = rows.repartitionByRange(_tasks(rows), *by).sortWithinPartitions(*by).drop(spread)
    placed = materialize(dealt.withColumn("at_", F.monotonically_increasing_id()), f"{name}-order").withColumn("task_", F.shiftright("at_", ROW_BITS))
    runs = placed.groupBy("tree", "task_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("run_"))
    ahead = Window.partitionBy("tree").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "task_", (F.coalesce(F.sum("run_").over(ahead), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("run_").over(Window.partitionBy("tree")).alias("n"))
    runs = materialize(runs, f"{name}-runs")
    return placed.join(runs, ["tree", "task_"]).withColumn("place", F.col("at_") + F.col("shift_")).drop("task_", "at_", "shift_")


def band_levels(arity: int) -> int:
    levels = 1
    while arity ** (levels + 1) <= BAND_NODES:
        levels += 1
    return levels


def links(nodes: DataFrame, most: int, arity: int, name: str) -> DataFrame:
    """Every parent of nodes(tree, n, place, digest) with its children's digests: (tree, n, level, place, digests). most
    is the largest tree's size. A tree of one leaf has no parents."""

    @frugal
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = Frontier(arity)
        for batch in batches:
            for tree, n, place, digest in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                front.take(tree, n, 0, place, digest)
            yield _batch(front.links)
            front.links = []
        yield _batch(list(front.rows()))

    ordered = nodes.select("tree", "n", "place", "digest").sortWithinPartitions("tree", "place")
    found = materialize(ordered.mapInArrow(grow, _LINKS), f"{name}-links")
    done, spark = [found.where("whole")], nodes.sparkSession
    band, top = band_levels(arity), 0
    while top < height(most, arity):
        top += band

        def key(r, top: int = top) -> tuple[str, int, int]:
            return r["tree"], max(r["level"], top), r["place"] // arity ** max(0, top - r["level"])

        def value(r) -> tuple:
            return r["tree"], r["n"], r["level"], r["places"], [bytes(d) for d in r["digests"]]

        met = found.where("NOT whole").rdd.map(lambda r, key=key: (key(r), value(r))).combineByKey(lambda v: Frontier(arity).partial(*v), lambda c, v: c.partial(*v), lambda a, b: a.merge(b), _tasks(nodes))
        found = materialize(spark.createDataFrame(met.flatMap(lambda kv: kv[1].rows()), _LINKS), f"{name}-links")
        done.append(found.where("whole"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("places", "whole")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_LINK_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINK_SCHEMA.types, strict=True)], schema=_LINK_SCHEMA)


def proofs(nodes: DataFrame, parents: DataFrame, most: int, arity: int, name: str) -> DataFrame:
    """nodes with `path`: the digests of the siblings on the way to the root, level by level, left to right, one after
    another. A root's path is empty."""
    payload = nodes.columns
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    band, top, paths = band_levels(arity), 0, None
    while top + band < height(most, arity):
        top += band
    for low in range(top, -1, -band):
        high = low + band
        chunk = lambda c, level, high=high: F.floor(F.col(c) / F.pow(F.lit(float(arity)), F.lit(high) - level)).cast("long")
        empty = {c: F.lit(None).cast(kinds[c]) for c in payload}
        rows = parents.where((F.col("level") > low) & (F.col("level") <= high)).select(F.col("tree").alias("t_"), chunk("place", F.col("level")).alias("c_"), F.col("level").alias("l_"), F.col("place").alias("p_"), F.col("digests").alias("d_"), F.lit(None).cast("binary").alias("path"), *[empty[c].alias(c) for c in payload])
        if paths is not None:
            rows = rows.unionByName(paths.select(F.col("t_"), F.col("p_").alias("c_"), F.lit(high + 1).alias("l_"), F.col("p_"), F.lit(None).cast("array<binary>").alias("d_"), "path", *[empty[c].alias(c) for c in payload]))
        if not low:
            rows = rows.unionByName(nodes.select(F.col("tree").alias("t_"), chunk("place", F.lit(0)).alias("c_"), F.lit(0).alias("l_"), F.col("place").alias("p_"), F.lit(None).cast("array<binary>").alias("d_"), F.lit(None).cast("binary").alias("path"), *payload))
        dealt = rows.repartition("t_", "c_").sortWithinPartitions("t_", "c_", F.desc("l_"), "p_")
        if low:
            paths = materialize(dealt.select("t_", "c_", "l_", "p_", "d_", "path").mapInArrow(_walk(arity, low), "t_ string, p_ long, path binary"), f"{name}-paths")
        else:
            schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in payload)
            return dealt.mapInArrow(_walk(arity, 0), f"{schema}, path binary")


def _walk(arity: int, low: int):
    """Down the links of one band: rows come sorted by chunk, the highest level first, so that one chunk's paths are
    held at a time."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}

        def ended() -> pa.RecordBatch:
            at = [(current[0], place, path) for (level, place), path in known.items() if level == low]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at, strict=True) if at else [[]] * 3, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["t_", "p_", "path"])

        for batch in batches:
            leaves, found = [], []
            for row, (tree, chunk, level, place, digests, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if (tree, chunk) != current:
                    if low and current is not None:
                        yield ended()
                    current, known = (tree, chunk), {}
                if digests is not None:
                    above = known.pop((level, place), b"")
                    for k in range(len(digests)):
                        known[level - 1, place * arity + k] = b"".join(digests[:k] + digests[k + 1 :]) + above
                elif level:
                    # the top of the chunk, whose path is known from the band above
                    known[level - 1, place] = path
                else:
                    leaves.append(row)
                    found.append(known.pop((0, place), b""))
            if not low:
                own = batch.take(pa.array(leaves, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[6:], pa.array(found, pa.binary())], [*own.schema.names[6:], "path"])
        if low and current is not None:
            yield ended()

    return run


def fold(digest: bytes, place: int, n: int, path: bytes, arity: int) -> tuple[bytes, bytes]:
    """(root, rest): what a node at a place of a tree of n leaves folds to with its siblings, and what of the path is left."""
    level, at = 0, 0
    while (wide := nodes_at(n, level, arity)) > 1:
        first = place // arity * arity
        others = min(arity, wide - first) - 1
        run = [path[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(others)]
        run.insert(place - first, digest)
        digest, place, level, at = joined(run), place // arity, level + 1, at + DIGEST * others
    return digest, path[at:]


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(docs: DataFrame, fields: list[Column], id_col: str = "doc_id", group_col: str = "lang", extra: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """(id, tree, place, n, digest, *extra, path, trees_place, trees_n, subroot, root): a row per row of docs.

    digest is the leaf over fields; place its number among the n leaves of its group by id, nulls first, ties by the
    digest; equal rows stand beside each other, each with a proof of its own. Every `arity` nodes become one, in the last
    run fewer, even one, until one is left, the subroot; a lone leaf is its own. Subroots ordered by group, null
    first, bytewise, likewise give root. path holds the siblings' digests of 32 bytes each up to the root. Null fields,
    empty and long texts are digested as they are; an empty table gives no rows; other columns are not read, so their
    names cannot clash. extra names columns of one's own, made from docs.
    """
    extra = extra or {}
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest(*fields).alias("digest"), *[c.alias(f"x_{k}") for k, c in extra.items()])
    with scratch(docs.sparkSession):
        leaves = numbered(rows, ["id", "digest"], "merkle-leaves")
        most = _largest(leaves)
        parents = links(leaves, most, arity, "merkle-leaves")
        held = materialize(proofs(leaves, parents, most, arity, "merkle-leaves"), "merkle-proofs", keep=True)
        alone = leaves.where("n = 1").select("tree", "digest")
        top = parents.where(F.col("level") == _height(F.col("n"), arity)).select("tree", _joined(F.col("digests")).alias("digest"))
        forest = alone.unionByName(top).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        subroots = numbered(forest, ["name"], "merkle-trees")
        trees = _largest(subroots)
        above = links(subroots, trees, arity, "merkle-trees")
        summit = above.where(F.col("level") == _height(F.col("n"), arity)).select(_joined(F.col("digests")).alias("digest"))
        root = (subroots.select("digest") if trees == 1 else summit).first()
        roots = proofs(subroots, above, trees, arity, "merkle-trees").select(F.col("name").alias("tree"), F.col("place").alias("trees_place"), F.col("n").alias("trees_n"), F.col("digest").alias("subroot"), F.col("path").alias("path_above"))
        roots = materialize(roots, "merkle-roots", keep=True)
    out = held.join(roots, "tree").withColumn("root", F.lit(bytes(root[0]) if root else None).cast("binary"))
    names = [F.col(f"x_{k}").alias(k) for k in extra]
    return out.select("id", "tree", "place", "n", "digest", *names, F.concat("path", "path_above").alias("path"), "trees_place", "trees_n", "subroot", "root")


def _height(n: Column, arity: int) -> Column:
    """Levels above n leaves, from the sizes that need one more."""
    return sum((F.when(n > F.lit(min(arity**k, 2**62)), 1).otherwise(0) for k in range(63) if arity**k <= 2**62), F.lit(0))


def _joined(digests: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "").cast("binary"), 256))


def folded(rows: DataFrame, leaf: str, arity: int = 2) -> DataFrame:
    """rows of manifest with `folded_root`: what the digest in column leaf folds to, over its group's tree and the
    groups'."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    where = {c: rows.columns.index(c) for c in (leaf, "place", "n", "path", "trees_place", "trees_n")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, place, n, path, above, trees in zip(*(batch.column(k).to_pylist() for k in where.values()), strict=True):
                subroot, rest = fold(digest, place, n, path, arity)
                out.append(fold(subroot, above, trees, rest, arity)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "folded_root"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in rows.columns) + ", folded_root binary")
