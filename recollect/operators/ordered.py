"""Work along an order, without a key's rows in one task: places, running sums, values carried on, chains of pointers.

Rows are dealt out by ranges of (keys, order) and walked by their task in that order. What a task needs of the tasks before it
is what they knew at their ends, of the one key that goes on: a count, sums or the last value. Only those rows, one for
each task, meet in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written

_ROW_BITS = 33  # of monotonically_increasing_id below the task's number
_BLOCK = 4096  # places that are cut at a time


def _changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before it; nulls are equal, the first row differs."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table.column(k)
        a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.to_numpy()
    new[:1] = True
    return new


Batches = Iterator[pa.RecordBatch]


def _dealt(rows: DataFrame, keys: list[str], order: list[Column], name: str, walk: Callable[[Batches], Batches], more: str, unique: bool) -> DataFrame:
    """rows in ranges of (keys, order), as each task walks over its own, with the columns `more` that the walk adds, their
    number `at_` and their `task_`. Rows equal in the order are told apart by where they were written first, so that many
    of them part too; where the order is unique, nothing is written first."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*map(F.col, keys), *order]
    if not unique:
        rows = written(rows.withColumn("spread_", F.monotonically_increasing_id()), f"{name}-rows")
        by.append(F.col("spread_"))
    placed = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).drop("spread_")
    walked = placed.mapInArrow(walk, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields], more]))
    return written(walked.withColumn("at_", F.monotonically_increasing_id()), f"{name}-order").withColumn("task_", F.shiftright("at_", _ROW_BITS))


def _with_carried(placed: DataFrame, keys: list[str], known: dict[str, Column], summed: bool, name: str) -> DataFrame:
    """placed, with `known` as the tasks before left it, where a row's key began in one of them; else null. known is of a
    row and those before it in its task."""
    key = F.struct(*keys, F.lit(0).alias("none__"))
    # two numbers of each task first: to find the rows themselves by their numbers would sort all rows
    edges = placed.groupBy("task_").agg(F.min("at_").alias("low_"), F.max("at_").alias("high_"))
    outer = placed.join(F.broadcast(edges), "task_").where((F.col("at_") == F.col("low_")) | (F.col("at_") == F.col("high_")))
    ends = outer.groupBy("task_").agg(F.min_by(key, "at_").alias("begins"), F.max_by(F.struct(key.alias("key"), "goes_on_", *[v.alias(c) for c, v in known.items()]), "at_").alias("last"))
    by_task = Window.partitionBy(F.lit(0)).orderBy("task_")
    before = F.lag("last").over(by_task)
    met = ends.select("task_", F.coalesce(F.col("begins").eqNullSafe(before["key"]), F.lit(False)).alias("met"), before.alias("before"))
    # a task that one key fills hands on what it was handed
    fresh = ~(F.col("met") & F.col("before.goes_on_"))
    group = met.withColumn("group", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(by_task))
    along = Window.partitionBy("group").orderBy("task_").rowsBetween(Window.unboundedPreceding, 0)
    total = (lambda c: F.sum(c).over(along)) if summed else (lambda c: F.last(c, ignorenulls=True).over(along))
    runs = written(group.select("task_", *[total(F.when(F.col("met"), F.col("before")[c])).alias(c) for c in known]), f"{name}-runs")
    out = placed.join(F.broadcast(runs), "task_").withColumns({c: F.when(F.col("goes_on_"), F.col(c)) for c in known})
    return out.drop("task_", "at_", "goes_on_")


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], sums: list[str] | None = None, name: str = "ranked", unique: bool = False) -> DataFrame:
    """rows with `place`, from 0 within the keys (null keys are a key), and for every column in sums, of whole numbers or
    doubles, the sum of the rows before, `before_<column>` (nulls count 0). The order decides; rows that are equal in it get
    places in some order, and go to one task if it is said to be unique."""
    order, sums = [F.col(c) if isinstance(c, str) else c for c in order], sums or []
    kinds = {c: "double" if rows.schema[c].dataType.simpleString() in ("float", "double") else "bigint" for c in sums}

    def walk(batches: Batches) -> Batches:
        last, goes_on, counts = None, True, [0] * (1 + len(sums))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            new = _changes(pa.concat_tables([last, table.select(keys)]), keys)[1:] if last is not None and keys else _changes(table, keys)
            if last is None or not keys:
                new[0] = False  # a task's first key may go on from the task before
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            own, begun = start >= 0, np.maximum(start, 0)
            added = []
            for k, value in enumerate([None, *sums]):
                one = np.ones(n, np.int64) if value is None else pc.fill_null(table[value].combine_chunks().cast(pa.float64() if kinds[value] == "double" else pa.int64()), 0).to_numpy(zero_copy_only=False)
                ahead = np.cumsum(one) - one
                found = np.where(own, ahead - ahead[begun], ahead + counts[k])
                counts[k] = found[-1] + one[-1]
                added.append(pa.array(found))
            head = ~own & goes_on
            goes_on = bool(head[-1])
            last = table.select(keys).slice(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, pa.array(head)], [*batch.schema.names, "place", *[f"before_{c}" for c in sums], "goes_on_"])

    placed = _dealt(rows, keys, order, name, walk, ", ".join(["place bigint", *[f"before_{c} {kinds[c]}" for c in sums], "goes_on_ boolean"]), unique)
    known = {"place__": F.col("place") + 1, **{f"sum_{c}__": F.col(f"before_{c}") + F.coalesce(F.col(c), F.lit(0)) for c in sums}}
    out = _with_carried(placed, keys, known, True, name)
    add = {"place": "place__", **{f"before_{c}": f"sum_{c}__" for c in sums}}
    return out.withColumns({c: F.col(c) + F.coalesce(F.col(a), F.lit(0)) for c, a in add.items()}).drop(*known).select(*rows.columns, *[f"before_{c}" for c in sums], "place")


def carried(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, into: str, name: str = "carried", unique: bool = False) -> DataFrame:
    """rows with `into`: the last value that is not null at or before each row of the order, within the keys. Rows equal in
    the order go to one task if it is said to be unique."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]

    def walk(batches: Batches) -> Batches:
        last, goes_on = None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch]).select([*keys, value]) if value not in keys else pa.Table.from_batches([batch]).select(keys)
            if last is not None:
                table = pa.concat_tables([last, table])
            new = _changes(table, keys)
            new[0] = False  # the row before, or a task's first key, which may go on from the task before
            at, held = np.arange(table.num_rows), table[value].combine_chunks()
            start = np.maximum.accumulate(np.where(new, at, 0))
            known = np.maximum.accumulate(np.where(held.is_valid().to_numpy(zero_copy_only=False), at, -1))
            found = held.take(pa.array(known, mask=known < start))
            head = (np.maximum.accumulate(new) == 0) & goes_on
            goes_on = bool(head[-1])
            tail = table.slice(table.num_rows - 1).to_pydict()
            tail[value] = found.slice(len(found) - 1).to_pylist()
            last = pa.table({c: pa.array(v, table.schema.field(c).type) for c, v in tail.items()})
            yield pa.RecordBatch.from_arrays([*batch.columns, found.slice(len(found) - n), pa.array(head[-n:])], [*batch.schema.names, into, "goes_on_"])

    placed = _dealt(rows, keys, order, name, walk, f"{into} {rows.schema[value].dataType.simpleString()}, goes_on_ boolean", unique)
    out = _with_carried(placed, keys, {"last__": F.col(into)}, False, name)
    return out.withColumn(into, F.coalesce(into, "last__")).select(*rows.columns, into)


def starts(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place): what is reached from place 0 by following pointers(keys, place, next); next is larger than place, or
    null at the end.

    Pointers double: after k rounds the first 2 ** k places are known and pointers reach as far, so a chain of n places
    takes log2(n) rounds. Every round is a join on (keys, place) and loses the pointers that reach past the end."""
    reached = pointers.where("place = 0").select(*keys, "place")
    jump = written(pointers.where("next IS NOT NULL").select(*keys, "place", "next"), "jump")
    while not jump.isEmpty():
        reached = written(reached.unionByName(reached.join(jump, [*keys, "place"]).select(*keys, F.col("next").alias("place"))), "reached")
        second = jump.select(*keys, F.col("place").alias("next"), F.col("next").alias("beyond"))
        jump = written(jump.join(second, [*keys, "next"]).select(*keys, "place", F.col("beyond").alias("next")), "jump")
    return reached


def _groups(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of some groups each; rows equal in the keys, which lie together, are never parted."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        new = np.flatnonzero(_changes(table, keys))
        if len(new) > 1:
            yield table.slice(0, new[-1]).combine_chunks()
        held = table.slice(new[-1]) if len(new) else None
    if held is not None:
        yield held.combine_chunks()


def _steps(table: pa.Table, keys: list[str], size: str, most_rows: int, most_size: int, block: int) -> tuple[np.ndarray, ...]:
    """For rows by (keys, block_, place): the row of their group's first place beyond the block (or its end), its end, and
    the row where a run from each would end."""
    new = _changes(table, [*keys, "block_"])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(new))
    place, of = table["place"].to_numpy(), table["block_"].to_numpy()
    beyond = ends - np.bincount(group, place >= (of + 1) * block, len(first)).astype(np.int64)
    sizes = table[size].to_numpy()
    until = np.cumsum(sizes)
    ahead = until - sizes
    at = np.arange(len(new))
    following = np.clip(np.searchsorted(until, ahead + most_size, "right"), at + 1, at + most_rows)
    return beyond[group], ends[group], np.minimum(following, ends[group])


def cut_runs(rows: DataFrame, keys: list[str], order: list[Column | str], size: str, most_rows: int, most_size: int, unique: bool = False) -> DataFrame:
    """rows cut along the order into runs of at most most_rows and, but for a first row that is larger, most_size in all:
    with `place`, the run's first place `head` and the place in the run `ordinal`. Keys must not be null; a null size is 0,
    none is negative. Rows equal in the order go to one task if it is said to be unique.

    Places are dealt out in blocks, each with the most_rows places after it, so that a block's runs are known once the place
    where it is entered is. A key of one block is entered at 0. Of longer keys each block says where every place that may be
    its entry leads to in the next one, and these pointers, few against the rows, are followed from place 0."""
    block = max(_BLOCK, 16 * most_rows)
    placed = ranked(rows.withColumn(size, F.coalesce(size, F.lit(0)).cast("long")), keys, order, name="cut-places", unique=unique)
    own = F.floor(F.col("place") / block).cast("long")
    both = F.when((own > 0) & (F.col("place") % block < most_rows), F.array(own, own - 1)).otherwise(F.array(own))
    by = [*keys, "block_"]

    def pointers(batches: Batches) -> Batches:
        for table in _groups(batches, by):
            beyond, end, following = _steps(table, keys, size, most_rows, most_size, block)
            inside = np.flatnonzero(following < beyond)
            exits = following.copy()
            while len(inside):
                exits[inside] = exits[exits[inside]]
                inside = inside[exits[inside] < beyond[inside]]
            place = table["place"].to_numpy()
            entry = np.flatnonzero((place - table["block_"].to_numpy() * block < most_rows) & (np.arange(len(place)) < beyond) & (exits < end))
            yield from table.select(keys).take(pa.array(entry)).append_column("place", pa.array(place[entry])).append_column("next", pa.array(place[exits[entry]])).to_batches()

    def runs(batches: Batches) -> Batches:
        for table in _groups(batches, by):
            marks = table["mark_"].to_numpy()
            marked = np.flatnonzero(marks)
            table = table.filter(pa.array(~marks))  # a mark is no row: it stands before the one that it names
            beyond, _, following = _steps(table, keys, size, most_rows, most_size, block)
            step, until, place = following.tolist(), beyond.tolist(), table["place"].to_numpy()
            heads = []
            for at in [*np.flatnonzero(place == 0).tolist(), *(marked - np.arange(len(marked))).tolist()]:
                stop = until[at]
                while at < stop:
                    heads.append(at)
                    at = step[at]
            heads = np.array(heads, np.int64)
            n = following[heads] - heads
            row = np.repeat(heads - (np.cumsum(n) - n), n) + np.arange(n.sum())
            head = np.repeat(place[heads], n)
            out = table.drop_columns(["block_", "mark_"]).take(pa.array(row))
            yield from out.append_column("head", pa.array(head)).append_column("ordinal", pa.array(place[row] - head)).to_batches()

    kinds = lambda fields: [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    of_keys = kinds(placed.schema[k] for k in keys)
    together = lambda found, *first: found.repartition(*by).sortWithinPartitions(*by, "place", *first)
    dealt = placed.withColumn("block_", F.explode(both)).withColumn("mark_", F.lit(False))
    long_keys = written(placed.where(F.col("place") == block).select(*keys), "cut-long-keys")
    if not long_keys.isEmpty():
        slim = dealt.select(*by, "place", size).join(long_keys, keys, "left_semi")
        entries = starts(written(together(slim).mapInArrow(pointers, ", ".join([*of_keys, "place bigint, next bigint"])), "cut-pointers"), keys)
        marks = entries.where(F.col("place") > 0).select(*keys, "place", F.floor(F.col("place") / block).cast("long").alias("block_"), F.lit(True).alias("mark_"))
        dealt = dealt.unionByName(marks, allowMissingColumns=True)
    return together(dealt, F.desc("mark_")).mapInArrow(runs, ", ".join([*kinds(placed.schema.fields), "head bigint, ordinal bigint"]))


def chains(links: DataFrame, most_rounds: int = 62) -> DataFrame:
    """(id, head, steps) for links(id, next), an id's successor or null: the end of each chain and how many links lead there;
    a chain that runs in a circle, or past most_rounds doublings, has a null head. A successor that has no row is an end.

    Pointers double, so chains of 2 ** k links take k rounds."""
    rows = links.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    ends = rows.where("next IS NULL").select("id", F.col("id").alias("head"), "steps")
    gone = rows.where("next IS NOT NULL").join(rows.select(F.col("id").alias("next")).distinct(), "next", "left_anti").select("id", F.col("next").alias("head"), "steps")
    done, going = written(ends.unionByName(gone), "chains-done"), rows.where("next IS NOT NULL").join(gone.select("id"), "id", "left_anti")
    going = written(going, "chains-going")
    for _ in range(most_rounds):
        if going.isEmpty():
            break
        arrived = going.join(done.select(F.col("id").alias("next"), "head", F.col("steps").alias("more")), "next").select("id", "head", (F.col("steps") + F.col("more")).alias("steps"))
        ahead = going.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("more"))
        # what goes in a circle only ever meets itself
        going, before = written(going.join(ahead, "next").select("id", F.col("beyond").alias("next"), (F.col("steps") + F.col("more")).alias("steps")), "chains-going"), going
        done = written(done.unionByName(arrived), "chains-done")
        left = going.count()
        if left and left == before.count() and arrived.isEmpty():
            break
    return done.unionByName(going.select("id", F.lit(None).cast(links.schema["id"].dataType).alias("head"), F.lit(None).cast("long").alias("steps")))
