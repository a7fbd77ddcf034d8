"""How the sources of a language differ in the words they use: a divergence for every two, and the terms that stand out.

Terms are counted in the tasks and summed per language, source and term. A group's terms lie in buckets of similar
count; the largest share in a bucket and the smallest share its terms have in the whole language bound what any term in
it can reach. Buckets are searched from the highest bound down, until all that are unseen lie strictly below the k-th
value found. Pairs of sources come from postings: only what both sources hold is joined, what one holds counts by its
histogram of counts, and what neither holds is a product.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .worker import frugal
from .words import pieces
from .workspace import materialize, scratch

SCALE = 1_000_000_000
#: Distinct terms that a task holds before it hands them on, and bytes of a long text cut into terms at a time.
HELD, PART = 200_000, 1 << 20
#: ASCII letters and all bytes of other characters make terms; A-Z are lower-cased; the rest parts them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, a part at a time."""
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        end = at + PART
        cut = data.find(b" ", end) if end < len(data) else -1
        end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for docs(lang, source, text as bytes): occurrences and documents of each term; a
    row with a null term for every group, so that groups without terms are known too."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = defaultdict(Counter)
        within: dict[tuple, Counter] = defaultdict(Counter)
        groups: set[tuple] = set()

        def report() -> pa.RecordBatch:
            rows = [(*g, t, n, within[g][t]) for g, held in times.items() for t, n in held.items()]
            rows += [(*g, None, 0, 0) for g in groups]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*made[:2], made[2].cast(pa.string()), *made[3:]], ["lang", "source", "term", "n", "docs"])

        for batch in (part for whole in batches for part in pieces(whole, 2)):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                group = lang, source
                groups.add(group)
                distinct: set[bytes] = set()
                for found in terms(text.as_py() or b""):
                    times[group].update(found)
                    distinct.update(found)
                within[group].update(distinct)
            if sum(map(len, times.values())) > HELD:
                yield report()
                times.clear(), within.clear(), groups.clear()
        yield report()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    below = (total + 2 * kept).cast("decimal(24,0)")
    above = (count + 2).cast("decimal(24,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); both are SCALE + 1 at most, so that longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def bucket(count: Column) -> Column:
    """A number that counts of about the same size share: the length in bits and the first four bits."""
    bits = F.bin(count)
    return F.length(bits) * 16 + F.conv(F.rpad(bits, 4, "0"), 2, 10).cast("int")


def top_terms(postings: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): the k terms that stand out most in each group of postings(lang, source, term,
    c, p, q), among those more frequent in the group than in the language; ties by the term's bytes."""
    numbered = postings.withColumn("bucket", bucket(F.col("c")))
    held = numbered.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q").withColumn("bound", divergence(F.col("p"), F.col("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    buckets = materialize(held.select("lang", "source", "bucket", "bound", F.row_number().over(order).alias("turn")), "term-buckets")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    unseen, seen, found = buckets, 0, None
    while not unseen.isEmpty():
        # best first, in turns that double: the unseen buckets of the groups that are still open
        turn = unseen.where(F.col("turn") <= 2 * seen + 2).select("lang", "source", "bucket")
        seen = 2 * seen + 2
        value = numbered.join(turn, ["lang", "source", "bucket"]).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        value = value if found is None else value.unionByName(found.drop("rank"))
        found = materialize(value.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "term-best")
        kth = found.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        unseen = buckets.where(F.col("turn") > seen).join(kth, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        unseen = materialize(unseen, "term-unseen")
    return found if found is not None else numbered.limit(0).select("lang", "source", F.col("term").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank"))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways: the divergence summed over all V
    kept terms. groups(lang, source, v, p0): p0 is the share of a term that the group lacks."""
    a = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("p0a"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    pairs = a.join(b, "lang").where("a < b")
    neither = divergence(F.col("p0a"), F.col("p0b"))
    base = pairs.select("lang", "a", "b", (F.col("v") * neither).alias("value"))
    histogram = materialize(postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")), "term-histogram")
    left = pairs.join(histogram.select("lang", F.col("source").alias("a"), "p", "m"), ["lang", "a"]).select("lang", "a", "b", (F.col("m") * (divergence(F.col("p"), F.col("p0b")) - neither)).alias("value"))
    right = pairs.join(histogram.select("lang", F.col("source").alias("b"), "p", "m"), ["lang", "b"]).select("lang", "a", "b", (F.col("m") * (divergence(F.col("p0a"), F.col("p")) - neither)).alias("value"))
    rows = postings.select("lang", "term", "source", "p", "p0")
    l, r = rows.toDF("lang", "term", "a", "pa", "p0a"), rows.toDF("lang", "term", "b", "pb", "p0b")
    both = l.join(r, ["lang", "term"]).where("a < b")
    f = divergence
    shared = both.select("lang", "a", "b", (f(F.col("pa"), F.col("pb")) - f(F.col("pa"), F.col("p0b")) - f(F.col("p0a"), F.col("pb")) + f(F.col("p0a"), F.col("p0b"))).alias("value"))
    total = base.unionByName(left).unionByName(right).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    total = materialize(total, "source-pairs")
    return total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language by the divergence of the
    two, largest first; part `term`: the k terms by which the source stands out most from its language.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; each language keeps those that at least
    min_docs of its documents hold. Null texts, languages and sources are ''; a group without kept terms takes part
    with counts of 0; in a language without kept terms all values are 0; ties go by the item's UTF-8 bytes; repeated
    rows are documents each; an empty table gives no rows; other columns are not read. All arithmetic is in whole
    numbers. Texts count whole, whatever their length.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("binary").alias("text"))
    with scratch(docs.sparkSession):
        counts = materialize(term_counts(rows), "term-counts")
        kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).drop("docs")
        kept = materialize(kept, "term-kept")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
        placed = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", F.col("n").alias("c"), "total"), "term-placed")
        sizes = placed.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        every = counts.where(F.col("term").isNull()).select("lang", "source")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        groups = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
        p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1)))).otherwise(1)
        groups = materialize(groups.withColumn("p0", p0), "term-groups")
        postings = placed.join(groups, ["lang", "source"]).select("lang", "source", "term", "c", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), "p0")
        postings = materialize(postings, "term-postings")
        found = top_terms(postings, k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pair_values(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
        return materialize(found.unionByName(pairs), "divergence", keep=True)
