"""Graphs of memories and projects: components, pages of neighbours, what may be restored beside what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chains, cut_runs, ranked
from .stages import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for edges(a, b): the smallest id that is reached, for every id in an edge; null ends have no edge.

    Each round ties a node's larger neighbours to the smallest node of its neighbourhood, then its smaller ones, so that
    trees flatten to stars; rounds grow with the logarithm of the ids, minima are taken in the tasks first, and a
    node with very many edges is never gathered."""
    pairs = written(_pairs(edges), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "far")
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        near = written(near, "edges")
        if near.exceptAll(pairs).isEmpty() and near.count() == pairs.count():
            break
        pairs = near
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _pairs(edges: DataFrame) -> DataFrame:
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def resolve_projects(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((project, resolved, members), (kind, value, projects, resolved, ambiguous)) of evidence(project, kind, value): paths,
    origins and names by which projects are known.

    Projects that share a piece of evidence, straight or through others, are one, named by the smallest. A collision is
    a piece of evidence of several projects; it is ambiguous if it is the only thing that holds one of them to the rest,
    that is, if that project has no other evidence. Null values tie nothing; a project without evidence of its own is not
    named; repeated rows count once. Projects are tied to the smallest that shares a piece of evidence, not to each
    other, so that a name of very many projects gives as many edges and no more."""
    rows = written(evidence.where("value IS NOT NULL AND project IS NOT NULL").select("project", "kind", "value").distinct(), "evidence")
    held = rows.groupBy("kind", "value").agg(F.min("project").alias("least"), F.count(F.lit(1)).alias("projects"))
    shared = written(held.where("projects > 1"), "shared-evidence")
    tied = rows.join(shared, ["kind", "value"]).select(F.col("project").alias("a"), F.col("least").alias("b"))
    found = written(components(tied), "projects")
    own = rows.groupBy("project").agg(F.count(F.lit(1)).alias("pieces"))
    named = own.join(found.withColumnRenamed("id", "project"), "project", "left").withColumn("resolved", F.coalesce("component", "project"))
    named = written(named.select("project", "resolved", "pieces"), "resolved-projects")
    sizes = named.groupBy("resolved").agg(F.count(F.lit(1)).alias("members"))
    alone = rows.join(named.where("pieces = 1"), "project").groupBy("kind", "value").agg(F.lit(True).alias("ambiguous"))
    collisions = shared.join(named.select(F.col("project").alias("least"), "resolved"), "least").join(alone, ["kind", "value"], "left")
    return named.join(sizes, "resolved").select("project", "resolved", "members"), collisions.select("kind", "value", "projects", "resolved", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def related(asked: DataFrame, edges: DataFrame, docs: DataFrame, direction: str = "both", limit: int = 16, tokens: int = 2048) -> DataFrame:
    """(asked, page, ordinal, direction, type, id, tokens): the memories that edges(source, target, type) tie to those of
    asked(id, project), by type, id and direction, in pages of at most limit items and, but for a first one that is larger,
    `tokens` in all.

    docs(id, private, project, tokens) has what can be shown: a private memory only within its own project. Edges to what
    docs has not, null ends and null ids give nothing; an edge from a memory to itself is outgoing. Pages are cut by
    pointers along the order, so that a memory with very many neighbours is not gathered either."""
    sides = []
    if direction in ("both", "outgoing"):
        sides.append(edges.select(F.col("source").alias("asked"), F.col("target").alias("id"), "type", F.lit("outgoing").alias("direction")))
    if direction in ("both", "incoming"):
        sides.append(edges.where("source <> target").select(F.col("target").alias("asked"), F.col("source").alias("id"), "type", F.lit("incoming").alias("direction")))
    every = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    rows = every.join(asked.select(F.col("id").alias("asked"), F.col("project").alias("from")), "asked").join(docs, "id")
    seen = rows.where(~F.coalesce("private", F.lit(False)) | F.col("project").isNull() | F.col("project").eqNullSafe(F.col("from"))).select("asked", "direction", "type", "id", "tokens")
    return paged_by_budget(seen, "asked", ["type", "id", "direction"], "tokens", limit, tokens)


def paged_by_budget(rows: DataFrame, key: str, order: list[Column | str], size: str, limit: int, most: int) -> DataFrame:
    """rows with the `page` each stands on within its key, and its `ordinal` there, both from 0."""
    cut = written(cut_runs(rows, [key], order, size, limit, most), "pages")
    heads = ranked(cut.where("ordinal = 0").select(key, "head"), [key], ["head"], name="page-heads").select(key, "head", F.col("place").alias("page"))
    return cut.join(heads, [key, "head"]).drop("head", "place")


def restore_unrepresented(candidates: DataFrame, represented: DataFrame, covered: DataFrame, explicit: DataFrame, least_signals: int = 2) -> DataFrame:
    """(session, ordinal, id): the candidates that a consolidation left out and that are put back, as a walk by ordinal
    would: each with explicit evidence or least_signals signs of importance whose statement is not there yet and whose
    evidence nothing there covers; what is put back counts as there for those after it.

    candidates(session, ordinal, id, statement, evidence, signals) with distinct ordinals; represented(session, statement),
    covered(session, evidence), explicit(session, evidence). Statements are compared trimmed; null ones and null evidence
    match nothing.

    A candidate is settled once it comes first for every statement and piece of evidence it has: it is put back, and all
    that share one with it fall away. Rounds settle many at a time, in every session at once; a round is a minimum per
    key, taken in the tasks first, so that a piece of evidence which very many cite is not gathered."""
    rows = candidates.select("session", "ordinal", "id", F.trim("statement").alias("statement"), F.array_distinct(F.coalesce("evidence", F.array().cast(candidates.schema["evidence"].dataType))).alias("evidence"), "signals")
    rows = written(rows, "candidates")
    cited = rows.select("session", "ordinal", F.explode("evidence").alias("evidence")).where("evidence IS NOT NULL")
    marks = lambda found, name: found.select("session", "ordinal").distinct().withColumn(name, F.lit(True))
    told = marks(cited.join(explicit.distinct(), ["session", "evidence"], "left_semi"), "told")
    known = marks(cited.join(covered.distinct(), ["session", "evidence"], "left_semi"), "known")
    open_ = rows.join(represented.select("session", F.trim("statement").alias("statement")).distinct(), ["session", "statement"], "left_anti").join(told, ["session", "ordinal"], "left").join(known, ["session", "ordinal"], "left")
    open_ = written(open_.where(F.col("known").isNull() & (F.coalesce("told", F.lit(False)) | (F.col("signals") >= least_signals))).select("session", "ordinal", "id", "statement", "evidence"), "candidates-open")
    keys = F.concat(F.array(F.concat(F.lit("s:"), "statement")), F.transform("evidence", lambda e: F.concat(F.lit("e:"), e.cast("string"))))
    edges = written(open_.select("session", "ordinal", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key")), "candidate-keys")
    # without a key nothing can stand against it
    taken = written(open_.select("session", "ordinal").join(edges, ["session", "ordinal"], "left_anti"), "restored")
    while not edges.isEmpty():
        first = edges.groupBy("session", "key").agg(F.min("ordinal").alias("first"))
        at = written(edges.join(first, ["session", "key"]), "candidate-firsts")
        won = at.groupBy("session", "ordinal").agg(F.bool_and(F.col("ordinal") == F.col("first")).alias("won")).where("won").select("session", "ordinal")
        won = written(won, "candidates-won")
        gone = edges.join(at.join(won, ["session", "ordinal"], "left_semi").select("session", "key"), ["session", "key"], "left_semi").select("session", "ordinal").distinct()
        taken = written(taken.unionByName(won), "restored")
        edges = written(edges.join(gone, ["session", "ordinal"], "left_anti"), "candidate-keys")
    return open_.join(taken, ["session", "ordinal"], "left_semi").select("session", "ordinal", "id")


def current_heads(revisions: DataFrame) -> DataFrame:
    """(id, head, steps, current) for revisions(id, next): the newest revision that each leads to."""
    return chains(revisions).withColumn("current", F.coalesce(F.col("steps") == 0, F.lit(False)))
