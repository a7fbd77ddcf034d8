"""Sharding in Hilbert-curve order, so that each shard covers a compact box of the metadata. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merkle import numbered
from .workspace import materialize

BITS = 4  # levels per dimension: 2 ** BITS
DIMS = 3
#: Bits of a task's first number in monotonically_increasing_id.
ROW_BITS = 33


def curve(spark: SparkSession) -> DataFrame:
    """(a, b, c, h): the curve index of every cell; 2 ** (BITS * DIMS) rows, whatever the data."""
    cells = spark.range(1 << (BITS * DIMS)).select(*[F.shiftright(F.col("id"), BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(c) for i, c in enumerate("abc")])
    return cells.select("a", "b", "c", F.expr(_hilbert_sql()).alias("h"))


def _hilbert_sql() -> str:
    """Index on the Hilbert curve of BITS bits a dimension, by the published transposition of axes (Skilling 2004):
    undo the excess work from the top bit down, Gray-encode, interleave. A fold over (bit, axis) steps with the three
    axes as the accumulator, as nested expressions would double at every bit."""
    steps = ", ".join(f"named_struct('q', {1 << bit}, 'i', {i})" for bit in range(BITS - 1, 0, -1) for i in range(DIMS))
    undone = (
        f"aggregate(array({steps}), array(a, b, c), (x, s) -> "
        "CASE WHEN (x[s.i] & s.q) != 0 THEN array(x[0] ^ (s.q - 1), x[1], x[2]) "
        "ELSE transform(x, (v, k) -> CASE WHEN s.i = 0 THEN v WHEN k = 0 OR k = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END) END)"
    )
    gray = "transform(array({0}), g -> array(g[0], g[1] ^ g[0], g[2] ^ g[1] ^ g[0]))[0]".format(undone)
    flips = ", ".join(str(1 << bit) for bit in range(BITS - 1, 0, -1))
    flipped = f"transform(array({gray}), g -> transform(g, v -> v ^ aggregate(array({flips}), 0, (t, q) -> CASE WHEN (g[2] & q) != 0 THEN t ^ (q - 1) ELSE t END)))[0]"
    bits = ", ".join(f"named_struct('s', {bit}, 'i', {i})" for bit in range(BITS - 1, -1, -1) for i in range(DIMS))
    return f"transform(array({flipped}), f -> aggregate(array({bits}), 0, (h, s) -> (h * 2) | (shiftright(f[s.i], s.s) & 1)))[0]"


def _ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, <name>): the place of every distinct value in the order of its whole UTF-8 bytes; null is before all, at -1."""
    values = rows.where(F.col(column).isNotNull()).select(F.lit("").alias("tree"), F.col(column)).distinct()
    return materialize(numbered(values, [column], f"shard-{name}").select(column, F.col("place").alias(name)), f"shard-{name}")


def hilbert_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, str] = ("lang", "source"), carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard; with carry also `row`, the whole row.

    Size is the text's UTF-8 bytes (null: none) plus 8. Language, source and size are quantised to 16 levels of about
    equal depth each; rows follow the Hilbert curve through the cells, inside a cell by the text's crc32 and size, then
    by doc_id. Equal texts lie together at the first of their places, so that only a cut can part them. The run is cut by the law `rows`: counts differ by one at
    most; the slot is the place in the shard from 0. The law has no growth rule, so grown_shard is null. Null metadata
    is a level of its own end of the scale; repeated rows keep a slot each; an empty table gives no rows.

    The whole order comes from one range exchange on (curve index, crc32, hash of doc_id), written once, so that a
    lost executor cannot change it; ranks are a task's offset plus the place in the task. Only per-task counts, a row
    a partition, are summed in one place.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(category_cols)],
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    more = ["row"] if carry else []
    rows = materialize(rows, "shard-rows")
    for i in range(len(category_cols)):
        rows = rows.join(_ranks(rows, f"v{i}", f"d{i}"), f"v{i}", "left").withColumn(f"d{i}", F.coalesce(f"d{i}", F.lit(-1)))
    rows = materialize(rows.withColumn("d2", F.col("size")).drop("v0", "v1"), "shard-levels")
    levels = [(i + 1) / (1 << BITS) for i in range((1 << BITS) - 1)]
    edges = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f"d{i}", levels, 10_000).alias(f"e{i}") for i in range(DIMS)]).first()

    def level(i: int) -> Column:
        bounds = sorted(set(edges[f"e{i}"] or []))
        return sum((F.when(F.col(f"d{i}") > F.lit(e), 1).otherwise(0) for e in bounds), F.lit(0))

    cells = rows.select("doc_id", "size", "text_crc32", *more, *[level(i).cast("int").alias(c) for i, c in enumerate("abc")])
    placed = cells.join(F.broadcast(curve(spark)), ["a", "b", "c"]).select("doc_id", "size", "text_crc32", *more, "h", F.xxhash64("doc_id", "text_crc32").alias("salt"))
    # equal texts whose metadata differ go to the first of their places
    apart = placed.groupBy("text_crc32", "size").agg(F.min("h").alias("to"), F.max("h").alias("last")).where("to < last").select("text_crc32", "size", "to")
    placed = placed.join(materialize(apart, "shard-groups"), ["text_crc32", "size"], "left").withColumn("h", F.coalesce("to", "h")).drop("to")
    order = ["h", "text_crc32", "size", "salt", "doc_id"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    numbered = materialize(dealt.select("doc_id", "size", "text_crc32", *more, F.monotonically_increasing_id().alias("at")), "shard-order")
    numbered = numbered.withColumn("task", F.shiftright("at", ROW_BITS).cast("int"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("task").agg(F.count(F.lit(1)).alias("in_task")).select("task", F.coalesce(F.sum("in_task").over(ahead), F.lit(0)).alias("offset"))
    offsets = materialize(offsets, "shard-offsets")
    base, longer = divmod(edges["n"], n_shards)
    split = longer * (base + 1)
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ranked = numbered.join(offsets, "task").withColumn("place", place)
    shard = F.when(F.col("place") < split, F.floor(F.col("place") / F.lit(base + 1))).otherwise(F.lit(longer) + F.floor((F.col("place") - split) / F.lit(max(base, 1)))).cast("int")
    ranked = ranked.withColumn("shard", shard)
    slot = F.col("place") - (F.col("shard") * F.lit(base) + F.least(F.col("shard"), F.lit(longer)))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)


def write_shards(docs: DataFrame, out: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", category_cols: tuple[str, str] = ("lang", "source")) -> None:
    """docs as Parquet below `out`: shards/shard=N with the rows of each shard in the order of their slots and the size as
    `size_`, and ranges with each shard's least and largest category values and sizes, which is what lets a reader skip it."""
    placed = hilbert_shards(docs, n_shards, id_col, text_col, category_cols, carry=True).select("shard", "slot", F.col("size").alias("size_"), "row.*")
    placed.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{out}/shards")
    kept = docs.sparkSession.read.parquet(f"{out}/shards")
    sides = [f(c).alias(f"{name}_{c}") for c in (*category_cols, "size_") for name, f in (("least", F.min), ("most", F.max))]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in category_cols]
    kept.groupBy("shard").agg(*sides, *nulls).coalesce(1).write.parquet(f"{out}/ranges")


def read_shards(docs_schema: str, spark: SparkSession, out: str, within: dict[str, tuple]) -> DataFrame:
    """The rows whose values lie within (least, most) for every column of within; a bound may be None for none. Shards whose ranges
    lie outside are not read at all. Nulls lie within nothing."""
    bounds = [(c, low, high) for c, (low, high) in within.items()]
    ranges = spark.read.parquet(f"{out}/ranges")
    inside = lambda least, most, low, high: (F.lit(True) if high is None else F.col(least) <= F.lit(high)) & (F.lit(True) if low is None else F.col(most) >= F.lit(low))
    near = ranges
    for c, low, high in bounds:
        near = near.where(inside(f"least_{c}", f"most_{c}", low, high))
    # a row a shard
    shards = sorted(r["shard"] for r in near.select("shard").collect())
    rows = spark.read.schema(f"{docs_schema}, slot long, size_ long, shard int").parquet(f"{out}/shards").where(F.col("shard").isin(shards))
    for c, low, high in bounds:
        rows = rows.where(F.col(c).isNotNull() & inside(c, c, low, high))
    return rows
