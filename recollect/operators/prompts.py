"""Evidence, scores and packs for prompts, for many prompts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import EpochPolicy, PackPolicy, PromptPolicy, ScorePolicy
from .stages import written


def term_weights(doc_terms: DataFrame, docs: Column | int, policy: ScorePolicy = ScorePolicy()) -> DataFrame:
    """(term, weight, rare) for doc_terms(id, term), distinct, of `docs` documents."""
    df = doc_terms.groupBy("term").agg(F.count("*").alias("df"))
    n = docs if isinstance(docs, Column) else F.lit(docs)
    rare = (F.col("df") <= F.greatest(F.lit(1), F.floor(n * policy.rare_fraction))) & (F.length("term") >= policy.rare_length)
    return df.select("term", F.log(1 + n / F.greatest(F.lit(1), F.col("df"))).alias("weight"), rare.alias("rare"))


def term_evidence(query_terms: DataFrame, doc_terms: DataFrame, weights: DataFrame, absent_weight: float) -> DataFrame:
    """(query_id, id, matched, matched_weight, total_weight, coverage, rare) of every pair that shares a term.

    A term that no document has weighs absent_weight and counts in the total only. The queries' terms are written first: where they
    are few, they are sent to the documents' and no task gathers a frequent term's documents."""
    asked = query_terms.join(weights, "term", "left").select("query_id", "term", F.coalesce("weight", F.lit(absent_weight)).alias("weight"), F.coalesce("rare", F.lit(False)).alias("rare"))
    asked = written(asked, "asked-terms")
    total = asked.groupBy("query_id").agg(F.sum("weight").alias("total_weight"))
    met = asked.join(doc_terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.sum("weight").alias("matched_weight"), F.bool_or("rare").alias("rare"))
    return met.join(total, "query_id").withColumn("coverage", F.round(F.col("matched_weight") / F.col("total_weight"), 6))


def applies(matched: Column, coverage: Column, rare: Column, policy: ScorePolicy = ScorePolicy()) -> Column:
    return ((matched >= 2) & (coverage >= policy.applicable_coverage)) | (rare & (coverage >= policy.rare_coverage))


def strong_exact(matched: Column, coverage: Column, rare: Column, policy: ScorePolicy = ScorePolicy()) -> Column:
    return rare | ((matched >= 2) & (coverage >= policy.exact_coverage))


def lexical_admission(terms: Column, matched: Column) -> Column:
    """Whether a text with `matched` of a query's `terms` counts as found by words: half of one or two, else two and 0.3."""
    share = matched / terms
    return F.when(terms <= 2, share >= 0.5).otherwise((matched >= 2) & (share >= 0.3))


def lift(similarities: DataFrame, policy: ScorePolicy = ScorePolicy()) -> DataFrame:
    """similarities(query_id, id, similarity) with `lift`, the distance from the query's upper median, and `leads`, whether
    the row is the query's nearest (ties: smaller id).

    In a scope of few documents the typical median stands in for the query's own."""
    middle = similarities.groupBy("query_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY similarity DESC)").alias("m"), F.count("*").alias("n"))
    middle = middle.select("query_id", F.when(F.col("n") >= policy.median_scope, F.col("m")).otherwise(policy.typical_median).alias("m"))
    best = similarities.groupBy("query_id").agg(F.max_by("id", F.struct("similarity", -F.col("id"))).alias("best"))
    known = similarities.join(middle, "query_id").join(best, "query_id")
    return known.select("query_id", "id", "similarity", F.round(F.col("similarity") - F.col("m"), 7).alias("lift"), (F.col("id") == F.col("best")).alias("leads"))


def scored(features: DataFrame, policy: ScorePolicy = ScorePolicy()) -> DataFrame:
    """features with score, band and anchored.

    features(direct, exact, applicable, signal, leads boolean; lift double or null; matched long; coverage double;
    lexical_rank or null)."""
    c = F.col
    strong, weak = F.coalesce(c("lift") >= policy.strong_lift, F.lit(False)), F.coalesce(c("lift") >= policy.weak_lift, F.lit(False))
    alone = c("leads") & F.coalesce(c("lift") >= policy.standalone_lift, F.lit(False))
    supported = c("lexical_rank").isNotNull() & (c("matched") >= 2)
    worded = supported & (c("coverage") >= policy.lexical_coverage)
    backed = c("exact") | c("applicable") | worded
    points = (
        F.when(c("direct"), 5).otherwise(0)
        + F.when(c("exact"), 4).otherwise(0)
        + F.when(alone, 4).when(strong & backed, 2).when(weak & backed, 1).otherwise(0)
        + F.when(supported & (c("lexical_rank") <= 3) & (c("coverage") >= 0.6), 2).when(worded & (c("lexical_rank") <= 10), 1).otherwise(0)
        + c("signal").cast("int")
        + c("applicable").cast("int")
    )
    rows = features.withColumn("score", points)
    band = F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "probable").otherwise("weak")
    return rows.withColumn("band", band).withColumn("anchored", c("direct") | c("exact") | alone | (strong & (c("applicable") | worded)))


def may_reach(least: int, features: dict[str, np.ndarray], lift: np.ndarray, leads: np.ndarray, policy: ScorePolicy = ScorePolicy()) -> np.ndarray:
    """Whether `scored` gives pairs least points, or may: a lift that is NaN counts as high, one that leads as standing
    alone. For pairs that are still arrays in a task, with features of the same names and no nulls, so that those which are
    weak whatever comes need not become rows."""
    c = features
    supported = c["matched"] >= 2
    worded = supported & (c["coverage"] >= policy.lexical_coverage)
    backed = c["exact"] | c["applicable"] | worded
    raised = ~(lift < policy.weak_lift) + (~(lift < policy.strong_lift)).astype(np.int8)
    lexical = np.where(supported & (c["lexical_rank"] <= 3) & (c["coverage"] >= 0.6), 2, (worded & (c["lexical_rank"] <= 10)).astype(np.int8))
    fixed = (lexical + c["applicable"]).astype(np.int8)
    points = raised * backed + fixed + c["signal"]
    return (points >= least) | c["direct"] | c["exact"] | leads


def one_hop(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(query_id, id, score, ...) in which neighbours of ids that score 4 or more gain a point if they have 2.

    Those neighbours are written first: where they are few, they are sent to the rows and not the rows to them."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("near")))
    lifted = rows.where("score >= 4").select("query_id", "id").join(both, "id").select("query_id", F.col("near").alias("id")).distinct().withColumn("lifted", F.lit(True))
    lifted = written(lifted, "one-hop")
    gain = (F.coalesce("lifted", F.lit(False)) & (F.col("score") >= 2)).cast("int")
    return rows.join(lifted, ["query_id", "id"], "left").withColumn("score", F.col("score") + gain).drop("lifted")


def unseen(rows: DataFrame, given: DataFrame) -> DataFrame:
    """rows(epoch, id, revision, ...) without those already given in the same epoch."""
    return rows.join(given, ["epoch", "id", "revision"], "left_anti")


def pack(ranked: DataFrame, policy: PackPolicy = PackPolicy()) -> DataFrame:
    """(query_id, position, id, kind, tokens, used) for ranked(query_id, position, id, band, tokens, full_tokens, exact).

    Ranked rows are walked in order: one that does not fit is skipped and the walk goes on; the number of items and of
    probable ones is bounded. In a second walk, exact high items change to their full form while the target holds. Both
    walks are folds over an array of one query's rows, inside the JVM."""
    row = F.struct("position", "id", "band", "tokens", "full_tokens", "exact")
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    item = "array<struct<position:int,id:bigint,band:string,tokens:bigint,full_tokens:bigint,exact:boolean>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("probable"), F.array().cast(item).alias("kept"))

    def step(s: Column, r: Column) -> Column:
        probable = r["band"] == "probable"
        fits = (s["used"] + r["tokens"] <= policy.hard_limit) & (F.size(s["kept"]) < policy.items) & (~probable | (s["probable"] < policy.probable_items))
        return F.struct(
            (s["used"] + F.when(fits, r["tokens"]).otherwise(0)).alias("used"),
            (s["probable"] + (fits & probable).cast("bigint")).alias("probable"),
            F.when(fits, F.concat(s["kept"], F.array(r))).otherwise(s["kept"]).alias("kept"),
        )

    chosen = "array<struct<position:int,id:bigint,kind:string,tokens:bigint>>"

    def grow(s: Column, r: Column) -> Column:
        gain = r["full_tokens"] - r["tokens"]
        full = (r["band"] == "high") & r["exact"] & (r["full_tokens"] <= policy.full_limit) & (s["used"] + gain <= policy.target)
        kept = F.struct(r["position"].alias("position"), r["id"].alias("id"), F.when(full, "standard").otherwise("compact").alias("kind"), F.when(full, r["full_tokens"]).otherwise(r["tokens"]).alias("tokens"))
        return F.struct((s["used"] + F.when(full, gain).otherwise(0)).alias("used"), F.concat(s["kept"], F.array(kept)).alias("kept"))

    walked = lists.select("query_id", F.aggregate("rows", start, step).alias("s"))
    second = F.struct(F.col("s.used").alias("used"), F.array().cast(chosen).alias("kept"))
    grown = walked.select("query_id", F.aggregate("s.kept", second, grow).alias("g"))
    return grown.select("query_id", F.col("g.used").alias("used"), F.explode("g.kept").alias("k")).select("query_id", "k.position", "k.id", "k.kind", "k.tokens", "used")


def epoch_budget(prompts: DataFrame, policy: EpochPolicy = EpochPolicy()) -> DataFrame:
    """(epoch, ordinal, tokens, spent, state) for prompts(epoch, ordinal, tokens): what was spent before each prompt, and
    whether its pack is open, restricted (soft) or blocked, in which case it is not spent."""
    lists = prompts.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tokens"))).alias("rows"))
    item = "array<struct<ordinal:bigint,tokens:bigint,spent:bigint,state:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast(item).alias("done"))

    def step(s: Column, r: Column) -> Column:
        over = s["spent"] + r["tokens"] > policy.hard
        state = F.when(over, "blocked").when(s["spent"] >= policy.soft, "soft").otherwise("open")
        row = F.struct(r["ordinal"].alias("ordinal"), r["tokens"].alias("tokens"), s["spent"].alias("spent"), state.alias("state"))
        return F.struct((s["spent"] + F.when(over, 0).otherwise(r["tokens"])).alias("spent"), F.concat(s["done"], F.array(row)).alias("done"))

    return lists.select("epoch", F.explode(F.aggregate("rows", start, step)["done"]).alias("k")).select("epoch", "k.*")


def _form(r: dict, soft: bool, p: PromptPolicy) -> tuple[str, int] | None:
    """The form in which a candidate may be shown, and its tokens: short, or a name that says more is to be read, or the full
    text where that is short itself; a probable one only short."""
    if r["compact_valid"] and r["compact_tokens"] <= p.compact_limit:
        return "compact", r["compact_tokens"] + p.item_tokens
    if r["band"] != "high":
        return None
    if r["tier"] != "normal" and r["identity_valid"] and r["identity_tokens"] <= p.identity_limit:
        return "identity", r["identity_tokens"] + p.item_tokens
    if not soft and r["standard_valid"] and r["standard_tokens"] <= p.plain_limit:
        return "standard", r["standard_tokens"] + p.item_tokens
    return None


class _Epoch:
    """What an epoch remembers from prompt to prompt: tokens spent and revisions shown, both bounded by its hard limit; and the
    pack of the prompt at hand."""

    def __init__(self, policy: PromptPolicy):
        self.policy, self.spent, self.shown = policy, 0, set()
        self.prompt, self.kept = None, []

    def begin(self, prompt) -> None:
        p = self.policy
        self.prompt, self.kept, self.probable = prompt, [], 0
        self.soft = self.spent >= p.epoch_soft
        self.used = p.later_tokens if self.spent else p.header_tokens

    def offer(self, r: dict) -> None:
        """The next candidate in order: taken if it may be shown and fits, else passed over."""
        p = self.policy
        if (r["id"], r["revision"]) in self.shown or len(self.kept) >= (p.soft_items if self.soft else p.items):
            return
        if self.soft and not (r["score"] >= p.soft_score and r["anchored"] and (r["human"] or r["tier"] != "normal")):
            return
        if r["band"] == "probable" and self.probable >= p.probable_items:
            return
        form = _form(r, self.soft, p)
        if form is None or self.used + form[1] > p.hard_limit or self.spent + self.used + form[1] > p.epoch_hard:
            return
        self.used += form[1]
        self.probable += r["band"] == "probable"
        self.kept.append([r, *form])

    def end(self) -> list[tuple]:
        """The pack: exact and direct ones in full where there is room, and what the epoch remembers of it."""
        p = self.policy
        for k, (r, _, tokens) in enumerate(self.kept):
            full = r["standard_tokens"] + p.item_tokens
            if not self.soft and r["band"] == "high" and r["standard_valid"] and r["standard_tokens"] <= p.full_limit and (r["exact"] or r["direct"]) and self.used + full - tokens <= (p.hard_limit if r["direct"] else p.target):
                self.used += full - tokens
                self.kept[k] = [r, "standard", full]
        out = [(r["epoch"], r["prompt"], k, r["id"], kind, tokens, self.used, self.spent, self.soft) for k, (r, kind, tokens) in enumerate(self.kept)]
        if self.kept:
            self.spent += self.used
            self.shown |= {(r["id"], r["revision"]) for r, _, _ in self.kept}
        return out


def epoch_packs(candidates: DataFrame, policy: PromptPolicy = PromptPolicy()) -> DataFrame:
    """(epoch, prompt, position, id, kind, tokens, used, spent, restricted): what each prompt of an epoch is given, in turn.

    candidates(epoch, prompt, id, revision, band, score, similarity, own, anchored, human, tier, direct, exact, compact_valid,
    compact_tokens, identity_valid, identity_tokens, standard_valid, standard_tokens): prompts go by number, candidates by
    band (high, then probable; weak ones are left out), score, similarity, own project first, id. Each is taken if its form fits
    under the pack's and the epoch's hard limit, and the walk goes on past one that does not; what the epoch has shown in
    the same revision is not shown again. Past the soft target only anchored candidates of soft_score with a human author
    or a tier above normal are taken, two a prompt. Then exact and direct ones are shown in full, in order, while the target
    (for direct ones the limit) holds. used is the pack's tokens, spent the epoch's before it. Null flags are false,
    null counts 0; a prompt that is given nothing has no row.

    A pack depends on those before it in its epoch, so a task reads an epoch in order; it keeps the tokens spent and what
    was shown, which the hard limit bounds, and gathers no candidates."""
    columns = ["epoch", "prompt", "id", "revision", "band", "score", "similarity", "own", "anchored", "human", "tier", "direct", "exact", "compact_valid", "compact_tokens", "identity_valid", "identity_tokens", "standard_valid", "standard_tokens"]
    flags = [c for c in columns if c in ("own", "anchored", "human", "direct", "exact") or c.endswith("_valid")]
    counts = [c for c in columns if c == "score" or c.endswith("_tokens")]
    rows = candidates.where(F.col("band").isin("high", "probable")).select(*columns)
    rows = rows.withColumns({"tier": F.coalesce("tier", F.lit("normal"))} | {c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in counts})
    order = ["epoch", "prompt", F.when(F.col("band") == "high", 0).otherwise(1), F.desc("score"), F.desc_nulls_last("similarity"), F.desc("own"), "id"]
    ordered = rows.repartition("epoch").sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["epoch", "prompt", "position", "id", "kind", "tokens", "used", "spent", "restricted"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, epoch = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_dict("records"):
                if epoch is None or (r["epoch"], r["prompt"]) != at:
                    if epoch is not None:
                        out += epoch.end()
                    if epoch is None or r["epoch"] != at[0]:
                        epoch = _Epoch(policy)
                    at = r["epoch"], r["prompt"]
                    epoch.begin(r["prompt"])
                epoch.offer(r)
            yield frame(out)
        if epoch is not None:
            yield frame(epoch.end())

    return ordered.mapInPandas(run, f"epoch {kinds['epoch']}, prompt {kinds['prompt']}, position long, id {kinds['id']}, kind string, tokens long, used long, spent long, restricted boolean")
