"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles, put in one global order with rare shingles first. Two sets with Jaccard
similarity of t or more share a shingle among the first |x| - ceil(t |x|) + 1 of each (the prefix). Documents with the
same prefix and size form one group; the groups' postings are joined by shingle, group pairs are filtered by size and
by the shingles' places, and what is left is expanded to members and verified on the whole sets.

Components come first, for which members of a component need no further comparison: a first round links every group to
the leader of each of its shingles, and a second compares only what still stands in different components, which finds
every link between components that the first left out. All links lie inside components then, and they are counted there:
a component's classes are dealt into salted blocks of bounded size, and every two blocks meet once, on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, words
from .components import components
from .worker import frugal
from .workspace import materialize, scratch, small_batches

#: Similarity as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 80, 100
#: Shingles counted at a time, sightings among them from which one is reported, most shingles in the common table.
COUNT_CHUNK, COUNT_LEAST, COMMON_ROWS = 2_500_000, 2, 1_000_000
#: Counts told apart when the table's least one is chosen.
MOST_LEVELS = 10_000
#: log2 of the bits in the filter of wanted ids.
WANTED_BITS = 27
#: Classes of one component in a block; columns of the incidence matrix multiplied at a time.
BLOCK, COLUMNS = 128, 4096


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _cut(levels: dict[int, int]) -> tuple[int, float]:
    """(level, share): all counts above the level and that share of those at it come to COMMON_ROWS, nearly."""
    held = 0
    for level in sorted(levels, reverse=True):
        if held + levels[level] > COMMON_ROWS:
            return level, (COMMON_ROWS - held) / levels[level]
        held += levels[level]
    return 0, 0.0


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts. They only decide the order, and any order is right."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for part in words.pieces(batch):
                for found in words.shingle_sets(part.column(1)):
                    held.append(found)
                    size += len(found)
                    if size >= COUNT_CHUNK:
                        yield report()
                        held, size = [], 0
        if held:
            yield report()

    reported = docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    reported = materialize(reported, "jaccard-counts")
    level = F.least("n", F.lit(MOST_LEVELS))
    with small_batches(docs.sparkSession):
        levels = reported.groupBy(level.alias("level")).count().collect()
        least, share = _cut({r["level"]: r["count"] for r in levels})
        # shingles are uniform numbers, so a share of them is a range
        below = int(share * 2**64) - 2**63
        top = reported.where((level > least) | ((level == least) & (F.col("shingle") < below))).toArrow()
    shingles, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the global order: uncommon ones by value, then common ones by count and value."""
    want = prefix_length(len(found))
    at = np.searchsorted(common, found)
    known = np.zeros(len(found), bool)
    inside = at < len(common)
    known[inside] = common[at[inside]] == found[inside]
    rare = found[~known]
    if len(rare) >= want:
        return rare[:want]
    often, n = found[known], counts[at[known]]
    return np.concatenate([rare, often[np.lexsort((often, n))][: want - len(rare)]])


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, group, prefix) for docs(doc_id, text as bytes): the set's size, digests of the sequence of
    words and of prefix and size; for documents without words n is 0 and the rest null."""
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("group", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in (part for whole in batches for part in words.pieces(whole)):
            n, digest, group, prefix = [], [], [], []
            for found in words.shingle_sets(batch.column(1)):
                n.append(len(found))
                if not len(found):
                    for column in (digest, group, prefix):
                        column.append(None)
                    continue
                first = _prefix(found, common, counts)
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                # two groups that share a number are compared as one, which only adds pairs to verify
                group.append(int.from_bytes(hashlib.blake2b(len(found).to_bytes(4, "little") + first.tobytes(), digest_size=8).digest(), "little", signed=True))
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(group, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n int, digest binary, group long, prefix array<long>")


def _postings(sets: DataFrame) -> DataFrame:
    """(shingle, n, p, group): the prefixes' shingles with their places, without those that only one document has."""

    def flat(batch: pa.RecordBatch, column: int) -> np.ndarray:
        return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    known = sets.where(F.col("prefix").isNotNull())
    size = bloom.cell_bits(known.agg(F.sum(F.size("prefix"))).first()[0] or 0)
    twice = known.sparkSession.sparkContext.broadcast(bloom.seen_twice(known.select("prefix"), lambda batch: flat(batch, 0), size))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = flat(batch, 2)
            length = np.array(batch.column(2).value_lengths())
            row = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(found)) - np.repeat(np.cumsum(length) - length, length)
            hit = np.flatnonzero(bloom.test(twice.value, found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[hit].view(np.int64)), batch.column(0).take(pa.array(row[hit])), pa.array(place[hit].astype(np.int32)), batch.column(1).take(pa.array(row[hit]))], ["shingle", "n", "p", "group"]
            )

    return known.select("n", "group", "prefix").mapInArrow(run, "shingle long, n int, p int, group long").distinct()


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes whose first common shingle is at these places can be similar enough: what is shared
    is at most the rest of either set, and must be t / (1 + t) of both sizes."""
    return F.least(na - pa_, nb - pb) * (NUMERATOR + DENOMINATOR) >= (na + nb) * NUMERATOR


class _Wanted:
    """A bit map, of fixed size whatever the input, of one document of each class that stands in pairs: it picks rows where they are read, so
    that the exchange for the exact join that follows carries little else."""

    def __init__(self, classes: DataFrame, pairs: DataFrame):
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        #: the classes that stand in pairs
        self.classes = classes.select("cid", "doc", "digest").join(ids, "cid", "left_semi")
        slot = self.slot("doc")
        maps = self.classes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
        self.bits = pairs.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in maps})

    @staticmethod
    def slot(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << WANTED_BITS))

    def marked(self, frame: DataFrame) -> DataFrame:
        """frame(id, ...) with the place of each id in the bit map as the last two columns."""
        slot = self.slot("id")
        return frame.where(F.col("id").isNotNull()).withColumns({"bucket": F.bitmap_bucket_number(slot), "bit": F.bitmap_bit_position(slot)})

    @staticmethod
    def pick(bits: dict[int, bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        places = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
        hit = [i for i, (bucket, bit) in enumerate(zip(*places, strict=True)) if (found := bits.get(bucket)) and found[bit >> 3] >> (bit & 7) & 1]
        return batch.take(pa.array(hit, pa.int64()))


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes whose whole sets are similar enough, and (id, shingles) of all classes in pairs; only
    documents in a pair are read in full."""
    wanted = _Wanted(classes, pairs)
    bits = wanted.bits

    @frugal
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in words.pieces(_Wanted.pick(bits.value, whole))):
            found = list(words.shingle_sets(batch.column(1)))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["doc", "digest", "shingles"])

    whole = wanted.marked(docs.select(F.col("doc_id").alias("id"), "text")).mapInArrow(sets, "doc long, digest binary, shingles array<long>")
    whole = whole.join(wanted.classes, ["doc", "digest"]).select(F.col("cid").alias("id"), "shingles").dropDuplicates(["id"])
    whole = materialize(whole, "jaccard-sets")
    left, right = whole.select(F.col("id").alias("a"), F.col("shingles").alias("x")), whole.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    good = common * DENOMINATOR >= (F.size("x") + F.size("y") - common) * NUMERATOR
    return joined.where(good).select("a", "b"), whole


def _count_links(members: DataFrame, whole: DataFrame) -> DataFrame:
    """(cid, linked): for members(cid, component, m, weight), m being the component's classes and whole their sets, the
    weights of the classes that are similar enough. Pairs never become rows: a block of them gives a sum per class."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(BLOCK)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.join(whole.withColumnRenamed("id", "cid"), "cid").select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "weight", "shingles")

    def linked(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        own, cid, weight = (np.concatenate([h[c] for h in held]) for c in range(3))
        sets = [x for h in held for x in h[3]]
        n = np.array([len(x) for x in sets])
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.full(len(values), -1)
        place[times > 1] = np.arange((times > 1).sum())
        row, column = np.repeat(np.arange(len(n)), n), place[column]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(n), len(n)), np.int64)
        for at in range(0, int((times > 1).sum()), COLUMNS):
            part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
            a = np.zeros((len(n), COLUMNS), np.float32)
            a[row[part], column[part] - at] = 1
            common += (a @ a.T).astype(np.int64)
        good = common * DENOMINATOR >= (n[:, None] + n - common) * NUMERATOR
        if own.min() != own.max():
            good &= own[:, None] != own
        np.fill_diagonal(good, False)
        return cid, good @ weight

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block pair, so that one is held at a time."""
        key, held, done = None, [], []

        def report() -> pa.RecordBatch:
            cid, n = (np.concatenate(x) for x in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n)], ["cid", "linked"])

        for batch in batches:
            component, i, j, own, cid, weight = (batch.column(c).to_numpy() for c in range(6))
            shingles = batch.column(6)
            offsets, flat = np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())]), shingles.flatten().to_numpy()
            cuts = (np.flatnonzero((np.diff(component) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist()
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                this = (component[start], i[start], j[start])
                if this != key and held:
                    done.append(linked(held))
                    held = []
                key = this
                held.append((own[start:stop], cid[start:stop], weight[start:stop], [flat[offsets[r] : offsets[r + 1]].copy() for r in range(start, stop)]))
            if done:
                yield report()
                done = []
        if held:
            done.append(linked(held))
            yield report()

    by = ("component", "i", "j")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "cid long, linked long").groupBy("cid").agg(F.sum("linked").alias("linked"))


def _by_prefix(sets: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose prefixes share enough. Of the set whose prefix ends first in the order, no shingle of the prefix
    can be shared beyond the other's prefix, so all that is shared is what the prefixes share and at most the rest."""
    wanted = _Wanted(classes, pairs)
    bits = wanted.bits

    @frugal
    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _Wanted.pick(bits.value, batch).select([0, 1, 2, 3])

    rows = wanted.marked(sets.select(F.col("doc_id").alias("id"), "digest", "n", "prefix")).mapInArrow(picked, "doc long, digest binary, n int, prefix array<long>")
    heads = rows.join(wanted.classes, ["doc", "digest"]).groupBy("cid", "n").agg(F.first("prefix").alias("prefix"))
    heads = materialize(heads, "jaccard-heads")
    l, r = heads.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("x")), heads.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("na") - F.size("x"), F.col("nb") - F.size("y"))
    return pairs.join(l, "a").join(r, "b").where(most * (NUMERATOR + DENOMINATOR) >= (F.col("na") + F.col("nb")) * NUMERATOR).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id), a row per row of docs: n_links is the number of other rows that are
    similar enough, equal ones included, component_id the smallest doc_id of the row's component.

    Equal sets are one class, however many doc_ids they have, and rows of one doc_id with different sets stand in
    different classes. Documents without words are empty and linked with nothing; shorter than a shingle, the whole
    sequence is the one shingle. Rows with a null doc_id take no part in links, have no links and a null component_id;
    repeated rows each get their row; an empty table gives no rows. Other columns are not read. Texts count whole,
    whatever their length.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sets = materialize(document_sets(texts), "jaccard-prefixes")
    with scratch(docs.sparkSession):
        final = _classes_linked(texts, sets)
    rows = sets.select("doc_id", "n", "digest").join(final, "digest", "left")
    known = F.col("doc_id").isNotNull()
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"))


def _classes_linked(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(digest, component, links): a row per class of equal sets, written."""
    named = sets.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # a class is its whole digest; its number is its place in the written table; doc is where its text is read
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("weight"), F.first("group").alias("group"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    postings = materialize(_postings(named), "jaccard-postings")
    leaders = postings.groupBy("shingle").agg(F.min(F.struct("p", "n", "group")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("shingle", "lead")
    shared = materialize(postings.join(leaders, "shingle"), "jaccard-shared")
    near = shared.where((F.col("group") != F.col("lead.group")) & _may_link(F.col("n"), F.col("p"), F.col("lead.n"), F.col("lead.p")))
    group_pairs = near.select("group", F.col("lead.group").alias("other")).distinct()
    heads = classes.groupBy("group").agg(F.min("cid").alias("head"), F.count("*").alias("members"))
    members = classes.select("group", F.col("cid").alias("a"))
    across = group_pairs.join(members, "group").join(heads.select(F.col("group").alias("other"), F.col("head").alias("b")), "other").select("a", "b")
    within = members.join(heads.where("members > 1"), "group").select("a", F.col("head").alias("b"))
    ordered = lambda pairs: pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = materialize(ordered(across.unionByName(within)), "jaccard-pairs")
    links, whole = _verify(texts, classes, materialize(_by_prefix(named, classes, first), "jaccard-likely"))
    links = materialize(links, "jaccard-links")
    found = components(links)

    placed = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("group", "cid", F.coalesce("component", "cid").alias("component"))
    placed = materialize(placed, "jaccard-placed")
    at = shared.select("shingle", "n", "p", "group").join(placed.select("group", "component").distinct(), "group")
    mixed = at.groupBy("shingle").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("shingle")
    still = materialize(at.join(mixed, "shingle"), "jaccard-open")
    by_component = still.select("shingle", "n", "p", "component").distinct()
    l, r = by_component.alias("l"), by_component.alias("r")
    apart = l.join(r, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.component") < F.col("r.component")) & _may_link(F.col("l.n"), F.col("l.p"), F.col("r.n"), F.col("r.p")))
    apart = apart.select(F.col("l.shingle").alias("shingle"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("n", "p", "component")])
    apart = materialize(apart, "jaccard-apart")

    def side(s: str) -> DataFrame:
        return still.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "p", "component")], F.col("group").alias(f"{s}_group"))

    crossing = apart.join(side("l"), ["shingle", "l_n", "l_p", "l_component"]).join(side("r"), ["shingle", "r_n", "r_p", "r_component"])
    crossing = crossing.select("l_group", "l_component", "r_group", "r_component").distinct()
    for s, name in (("l", "a"), ("r", "b")):
        crossing = crossing.join(placed.select(F.col("group").alias(f"{s}_group"), F.col("component").alias(f"{s}_component"), F.col("cid").alias(name)), [f"{s}_group", f"{s}_component"])
    crossing = crossing.select("a", "b")
    several = placed.groupBy("group").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("group")
    inner = placed.join(several, "group")
    inside = inner.alias("l").join(inner.alias("r"), (F.col("l.group") == F.col("r.group")) & (F.col("l.component") < F.col("r.component"))).select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b"))
    second = materialize(ordered(crossing.unionByName(inside)).join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    if not second.isEmpty():
        more, also = _verify(texts, classes, materialize(_by_prefix(named, classes, second), "jaccard-likely"))
        more = materialize(more, "jaccard-links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
            whole = whole.unionByName(also.join(whole.select("id"), "id", "left_anti"))
    placed = classes.select("cid", "doc", "weight").join(found.withColumnRenamed("node", "cid"), "cid")
    members = placed.join(placed.groupBy("component").agg(F.min("doc").alias("name"), F.count("*").alias("m")), "component")
    members = materialize(members, "jaccard-members")
    linked = materialize(_count_links(members.select("cid", "component", "m", "weight"), whole), "jaccard-counts")
    final = classes.join(members.select("cid", "name"), "cid", "left").join(linked, "cid", "left")
    final = final.select("digest", F.coalesce("name", "doc").alias("component"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    return materialize(final, "jaccard-components", keep=True)
