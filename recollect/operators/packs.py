"""What a session or a prompt is given under a budget: drawn in rounds, cut into paragraphs, packed by a fold.

A fold walks over an array. What may stand in it is bounded first: a walk that only ever has less room takes, of rows that
cost the same, the first ones, so that of each cost only as many are gathered as the pack has places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import ExcerptPolicy, SessionPolicy
from ..functions.text import token_estimate
from .ordered import ranked
from .stages import written

# The tiers in their order; a project's own memories stand one higher.
TIERS = ("critical", "strong", "normal")


def session_candidates(requests: DataFrame, docs: DataFrame, policy: SessionPolicy = SessionPolicy()) -> DataFrame:
    """(request_id, id, phase, tier, round, category, kind, tokens, draw) in the order in which a session's memories are drawn.

    requests(request_id, project, at), docs(id, project, tier, category, startup, order_key, compact_valid, compact_tokens,
    identity_valid, identity_tokens, valid_from, valid_until): project is null for all projects. startup `always` comes before
    `auto`, then tiers, and within a tier one of each category in turn, categories by name and their memories by
    order_key and id; those without a form that may be shown take their turn and are left out. Nulls in valid_from and
    valid_until set no bound, `never` and a null startup are not drawn. A request meets its own project's memories and
    those of all projects, each by one equal join."""
    here = F.concat(F.lit("p:"), F.col("project").cast("string"))
    wide = requests.select("request_id", "project", "at", F.explode(F.array(F.lit("all"), here)).alias("scope")).where("scope IS NOT NULL")
    held = docs.withColumn("scope", F.coalesce(here, F.lit("all"))).withColumnRenamed("project", "own")
    rows = wide.join(held, "scope").where(F.col("startup").isin("always", "auto") & F.coalesce(F.col("valid_from") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("valid_until") >= F.col("at"), F.lit(True)))
    base = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int") - 1
    rows = rows.withColumn("rank", F.greatest(F.lit(0), base - F.when(F.col("own").isNotNull(), 1).otherwise(0)))
    phase = F.when(F.col("startup") == "always", 0).otherwise(1)
    rows = rows.select("request_id", "id", phase.alias("phase"), "rank", "category", "order_key", "compact_valid", "compact_tokens", "identity_valid", "identity_tokens")
    placed = ranked(rows, ["request_id", "phase", "rank", "category"], ["order_key", "id"], name="session-rounds")
    compact = F.col("compact_valid") & (F.col("compact_tokens") <= policy.compact_limit)
    # an identity alone stands for what is not normal
    identity = (F.col("rank") < len(TIERS) - 1) & F.col("identity_valid") & (F.col("identity_tokens") <= policy.identity_limit)
    kind = F.when(compact, "compact").when(identity, "identity")
    cost = F.when(compact, F.col("compact_tokens")).otherwise(F.col("identity_tokens")) + policy.item_tokens
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank") + 1)
    out = placed.select("request_id", "id", "phase", "rank", tier.alias("tier"), F.col("place").alias("round"), "category", kind.alias("kind"), cost.cast("long").alias("tokens")).where("kind IS NOT NULL")
    return out.withColumn("draw", F.struct("phase", "rank", "round", "category", "id")).drop("rank")


def pack_sessions(requests: DataFrame, docs: DataFrame, policy: SessionPolicy = SessionPolicy()) -> DataFrame:
    """(request_id, position, id, tier, kind, tokens): the memories each request starts with: of the candidates in turn
    each that fits, up to items in all and identities of them shown by name only, within tokens in all and always_tokens
    for those always shown; what does not fit is passed over and the walk goes on. A request with none has no row.

    Of one phase, kind and cost only the first `items` candidates can be taken, since room only shrinks; no more are gathered,
    however many memories a project has."""
    drawn = session_candidates(requests, docs, policy)
    alike = Window.partitionBy("request_id", "phase", "kind", "tokens").orderBy("draw")
    few = written(drawn.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= policy.items), "session-candidates")
    lists = few.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("draw", "id", "phase", "tier", "kind", "tokens"))).alias("rows"))
    item = "array<struct<id:bigint,tier:string,kind:string,tokens:bigint>>".replace("bigint,tier", f"{few.schema['id'].dataType.simpleString()},tier")
    start = F.struct(F.lit(policy.header_tokens).cast("long").alias("used"), F.lit(0).cast("long").alias("always"), F.lit(0).alias("named"), F.array().cast(item).alias("items"))

    def step(s: Column, r: Column) -> Column:
        always, identity = r["phase"] == 0, r["kind"] == "identity"
        fits = (F.size(s["items"]) < policy.items) & (s["used"] + r["tokens"] <= policy.tokens) & (~always | (s["always"] + r["tokens"] <= policy.always_tokens)) & (~identity | (s["named"] < policy.identities))
        return F.struct(
            (s["used"] + F.when(fits, r["tokens"]).otherwise(0)).alias("used"),
            (s["always"] + F.when(fits & always, r["tokens"]).otherwise(0)).alias("always"),
            (s["named"] + F.when(fits & identity, 1).otherwise(0)).alias("named"),
            F.when(fits, F.concat(s["items"], F.array(F.struct(r["id"].alias("id"), r["tier"].alias("tier"), r["kind"].alias("kind"), r["tokens"].alias("tokens"))))).otherwise(s["items"]).alias("items"),
        )

    taken = lists.select("request_id", F.posexplode(F.aggregate("rows", start, step)["items"]).alias("position", "item"))
    return taken.select("request_id", F.col("position").cast("long").alias("position"), "item.id", "item.tier", "item.kind", "item.tokens")


# Words that say nothing of a prompt's subject, and what marks plans, constraints and names.
GENERIC = ("一下", "这个", "那个", "当前", "现在", "之前", "目前", "帮我", "可以", "是否", "什么", "为什么", "怎么", "你的", "我的", "好的", "the", "this", "that", "please")
PLAN = r"(?iu)建议|方案|改为|recommend|propos|plan"
ASKS_PLAN = r"(?iu)推荐|建议|方案|按照|照做|recommend|propos|plan"
CONSTRAINT = r"(?iu)不得|不能|不要|禁止|不应|除非|仅|不适用|尚未|没有|不代表|未获|尚不能|must not|do not|only|unless"
ENTITY = r"`[^`\n]+`|(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*(?![A-Za-z0-9_])"
SPACE = r"\t\n\f\r "  # white space without the vertical tab and without line ends beyond ASCII


def prompt_terms(prompt: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(prompt, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC)))


def conversation_paragraphs(asked: DataFrame, messages: DataFrame, policy: ExcerptPolicy = ExcerptPolicy()) -> DataFrame:
    """(prompt_id, message, ordinal, role, text, priority, score, tokens): the paragraphs of a prompt's last messages.

    asked(prompt_id, prompt), messages(prompt_id, back, role, text): back counts from 1, the newest; those beyond the limit are
    left out. A paragraph ends at a blank line and is never cut. priority 0: a plan of the newest assistant message when
    the prompt asks for one; 1 and 2: the first paragraph of substance of the newest assistant and user message; else 3."""
    last = messages.where(F.col("back") <= policy.messages).select("prompt_id", "back", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    newest = last.groupBy("prompt_id").agg(*[F.min(F.when(F.col("role") == r, F.col("back"))).alias(r) for r in ("assistant", "user")])
    rows = last.join(newest, "prompt_id").join(asked.select("prompt_id", prompt_terms(F.col("prompt")).alias("terms"), F.coalesce(F.col("prompt"), F.lit("")).rlike(ASKS_PLAN).alias("asks_plan")), "prompt_id")
    parts = F.filter(F.transform(F.split("text", rf"\n[{SPACE}]*\n"), lambda p: F.regexp_replace(p, rf"^[{SPACE}]+|[{SPACE}]+\z", "")), lambda p: p != "")
    rows = rows.withColumn("parts", parts)
    solid = F.transform("parts", lambda p: F.length(F.regexp_replace(p, rf"[*{SPACE}]", "")) > 8)
    first = F.greatest(F.lit(0), F.array_position(solid, F.lit(True)) - 1)
    rows = rows.select("prompt_id", "back", "role", "assistant", "user", "terms", "asks_plan", first.alias("first"), F.posexplode("parts").alias("ordinal", "text"))
    lower, plan = F.lower("text"), F.col("text").rlike(PLAN)
    overlap = F.least(F.lit(policy.overlap), F.size(F.filter("terms", lambda w: F.contains(lower, w))))
    entities = F.least(F.lit(policy.entities), F.regexp_count("text", F.lit(ENTITY)))
    mine = lambda role: F.coalesce(F.col("back") == F.col(role), F.lit(False))
    priority = F.when(mine("assistant") & F.col("asks_plan") & plan, 0).when(mine("assistant") & (F.col("ordinal") == F.col("first")), 1).when(mine("user") & (F.col("ordinal") == F.col("first")), 2).otherwise(3)
    tokens = token_estimate(F.col("text"))
    recent = policy.recent / (1 + (F.col("back") - 1) * policy.fade)
    score = (recent + overlap * 3 + entities * 1.5 + F.when(F.col("text").rlike(CONSTRAINT), 4).otherwise(0) + F.when(plan, 4).otherwise(0) + F.when(F.col("ordinal") == 0, 3).otherwise(0)) / F.sqrt(F.greatest(F.lit(policy.least_tokens), tokens))
    return rows.select("prompt_id", F.col("back").cast("long").alias("message"), F.col("ordinal").cast("long").alias("ordinal"), "role", "text", priority.alias("priority"), F.round(score, 6).alias("score"), tokens.alias("tokens"))


def conversation_excerpt(asked: DataFrame, messages: DataFrame, budget: int, policy: ExcerptPolicy = ExcerptPolicy()) -> DataFrame:
    """(prompt_id, position, message, text, tokens): what a prompt is shown of its last messages, oldest first.

    All of them whole, if they fit the budget with their labels. Otherwise paragraphs, by priority, then score, then
    the newer message and the earlier place; each that still fits, equal ones of one role once. Null texts are empty;
    a prompt without messages has no row. A prompt's paragraphs are those of policy.messages messages, so a group is bounded
    by what those hold."""
    parts = written(conversation_paragraphs(asked, messages, policy), "paragraphs")
    last = messages.where(F.col("back") <= policy.messages).select("prompt_id", F.col("back").cast("long").alias("message"), F.coalesce("text", F.lit("")).alias("text"))
    whole = last.withColumn("tokens", token_estimate(F.col("text")) + policy.label_tokens)
    full = written(whole.groupBy("prompt_id").agg(F.sum("tokens").alias("all")).where(F.col("all") <= budget).select("prompt_id"), "whole-excerpts")
    alike = Window.partitionBy("prompt_id", "role", F.sha2("text", 256)).orderBy("priority", F.desc("score"), "message", "ordinal")
    cost = F.col("tokens") + policy.label_tokens
    once = parts.join(full, "prompt_id", "left_anti").where(cost <= budget).withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    lists = once.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("priority", (-F.col("score")).alias("less"), "message", "ordinal", cost.alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<message:bigint,ordinal:bigint>>").alias("items"))

    def step(s: Column, r: Column) -> Column:
        fits = s["used"] + r["cost"] <= budget
        one = F.array(F.struct(r["message"].alias("message"), r["ordinal"].alias("ordinal")))
        return F.struct((s["used"] + F.when(fits, r["cost"]).otherwise(0)).alias("used"), F.when(fits, F.concat(s["items"], one)).otherwise(s["items"]).alias("items"))

    taken = lists.select("prompt_id", F.explode(F.aggregate("rows", start, step)["items"]).alias("i")).select("prompt_id", "i.message", "i.ordinal")
    cut = taken.join(parts, ["prompt_id", "message", "ordinal"]).select("prompt_id", "message", "ordinal", "text", cost.alias("tokens"))
    both = cut.unionByName(whole.join(full, "prompt_id").select("prompt_id", "message", F.lit(0).cast("long").alias("ordinal"), "text", "tokens"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("message"), "ordinal")) - 1
    return both.select("prompt_id", place.cast("long").alias("position"), "message", "text", "tokens")
