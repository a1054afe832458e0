"""Query intelligence: rules, variants, plans, routing, budgets, principals and cache keys, as columns over a query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rule families, case-insensitive unless noted.
ARITHMETIC = r"\d[\d,.]*\s*(?:[-+*/^]|%\s+of|%\s*of|percent\s+of|divided\s+by|times)\s*\d|\b(?:calculate|compute|work\s+out)\b"
TRANSFORM_VERB = r"\b(summari[sz]e|rewrite|rephrase|translate|reformat|convert|shorten|expand)\b"
SELF_REFERENTIAL = (
    r"\b(the (?:above|following|text|code|snippet) (?:i|I)? ?(?:just )?(?:pasted|sent|gave)?|this (?:text|code|snippet|paragraph|message)"
    r"|what (?:did )?(?:we|you|i) (?:just )?(?:say|decide|discuss|agree))\b"
)
LIVE_DATA = r"\b(right now|currently|at the moment|today'?s?|latest|live|real[- ]?time|current (?:price|status|value|rate|balance)|as of (?:today|now|this morning))\b"
EXACT_QUOTATION = r"\b(verbatim|word[- ]for[- ]word|exact (?:wording|text|quote|language)|quote (?:the|me)|exactly what (?:it|the \w+) says)\b"
PRIVATE_SCOPE = r"\b(our|my|we|us|the company'?s?|internal|in[- ]house|this (?:team|org|tenant))\b"
CITATION_DEMAND = r"\b(cite|citation|source|sources|according to|where does it say|which document)\b"
MULTI_HOP = r"\b(compare|versus|vs\.?|difference between|and then|both .+ and |how does .+ (?:affect|relate|compare))\b"
GREETING = r"^\s*(hi|hello|hey|thanks|thank you|ok|okay|got it|never ?mind)\b[\s!.?]*$"
PRONOUN = r"\b(it|its|that|this|they|them|those|there)\b"
FILLER_PREFIX = r"^\s*(?:please\s+|could you\s+|can you\s+|i(?:'d| would) like to know\s+|tell me\s+)+"
TRAILING_POLITENESS = r"\s*(?:please|thanks|thank you)\s*[.!?]*\s*$"
CONJUNCTION = r"\s+(?:and then|and also|as well as|;|\band\b(?=\s+(?:how|what|when|where|why|who|which)))\s+"
COMPARISON = r"\b(?:difference between|compare)\s+(.+?)\s+(?:and|versus|vs\.?|with)\s+(.+?)\s*[?.]?\s*$"
QUESTION_WORD = r"^\s*(who|what|when|where|why|how|which|is|are|do|does|can)\b"
ENTITY = r"\b(?:[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*|[a-z]+-\d+|[A-Z]{2,})\b"
ALIASES = {
    "sev-1": ("sev1", "severity 1", "p1", "priority 1"),
    "sev-2": ("sev2", "severity 2", "p2", "priority 2"),
    "on-call": ("oncall", "on call", "rota"),
    "escalate": ("escalation", "escalated", "page", "paged"),
    "retention": ("retained", "retain", "archival", "archive"),
    "sla": ("service level agreement", "service level"),
    "acl": ("access control list", "permissions"),
}
HALF_LIFE_DAYS = {"static": 3650.0, "slow": 180.0, "fast": 7.0, "realtime": 0.04}
TTL_SECONDS = {"static": 86400, "slow": 14400, "fast": 900, "realtime": 0}
#: Strategy, expected latency in ms and cost in USD; quality prior and its weight in samples.
PROFILES = (("parametric", 420.0, 0.0016), ("non_parametric", 1150.0, 0.0043), ("hybrid", 1380.0, 0.0057))
PRIOR_QUALITY, PRIOR_SAMPLES, HEDGE_ABOVE = 0.62, 20.0, 0.35
MOST_SUB_QUERIES = 6
#: Level and the remaining fraction of the scarcest budget at which it starts.
LADDER = ((1, 0.50), (2, 0.35), (3, 0.25), (4, 0.15), (5, 0.08), (6, 0.0))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def rule_fields(query: Column) -> dict[str, Column]:
    """What the rules settle about a query; null where they don't. Later rules overwrite earlier ones."""
    hit = {k: matches(query, p) for k, p in {
        "arithmetic": ARITHMETIC, "self": SELF_REFERENTIAL, "verb": TRANSFORM_VERB, "live": LIVE_DATA, "quote": EXACT_QUOTATION, "private": PRIVATE_SCOPE, "cite": CITATION_DEMAND, "multi": MULTI_HOP,
    }.items()}
    greeting, transformation = matches(query, GREETING), hit["verb"] & hit["self"]
    none = F.lit(None)
    settled = {
        "intent": F.when(transformation, "transformation").when(hit["arithmetic"], "computation"),
        "complexity": F.when(hit["multi"], "multi_step").when(transformation | hit["arithmetic"], "simple_factual"),
        "requires_external_knowledge": F.when(hit["private"] | hit["live"], True).when(hit["self"] | hit["arithmetic"], False),
        "requires_live_data": F.when(hit["live"], True),
        "requires_private_data": F.when(hit["private"], True),
        "requires_exact_quotation": F.when(hit["quote"], True),
        "requires_citation": F.when(hit["cite"] | hit["quote"], True).when(hit["self"] | hit["arithmetic"], False),
        "multi_hop": F.when(hit["multi"], True),
        "volatility": F.when(hit["live"], "realtime"),
    }
    count = sum((c.isNotNull().cast("int") for c in settled.values()), F.lit(0))
    chat = {"intent": "conversational", "complexity": "trivial", "requires_external_knowledge": False, "requires_live_data": False, "requires_private_data": False, "requires_citation": False, "multi_hop": False}
    out = {k: F.when(greeting, F.lit(chat[k]) if k in chat else none).otherwise(c) for k, c in settled.items()}
    return out | {"coverage": F.when(greeting, 1.0).otherwise(F.least(F.lit(1.0), count / 8.0))}


def analysed(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    """Adds rule fields, defaults, uncertainty, half-life, ambiguity and quality."""
    rows = queries.select("*", *[c.alias(k) for k, c in rule_fields(F.col(text_col)).items()])
    words = F.size(F.filter(F.split(text_col, r"\s+"), lambda w: w != ""))
    pronoun = matches(F.col(text_col), PRONOUN)
    asks = matches(F.col(text_col), QUESTION_WORD)
    volatility = F.coalesce("volatility", F.lit("slow"))
    life = F.create_map(*[F.lit(x) for kv in HALF_LIFE_DAYS.items() for x in kv])
    return rows.select(
        "*",
        F.round(1 - F.col("coverage"), 3).alias("uncertainty"),
        (F.col("coverage") < 0.6).alias("escalated"),
        F.coalesce("requires_external_knowledge", F.lit(True)).alias("needs_retrieval"),
        F.coalesce("requires_citation", F.lit(True)).alias("needs_citation"),
        F.element_at(life, volatility).alias("half_life_days"),
        F.when(pronoun, "unresolved_reference").when((words <= 2) & ~asks, "underspecified").otherwise("none").alias("ambiguity"),
        (words < 4).alias("needs_rewrite"),
        F.when((words >= 6) & ~pronoun, 0.9).when(words >= 4, 0.55).otherwise(0.3).alias("quality"),
    )


def entities(query: Column) -> Column:
    """Capitalised runs and identifiers, the first of each spelling."""
    found = F.filter(F.regexp_extract_all(query, F.lit(f"(?U){ENTITY}"), F.lit(0)), lambda e: (F.length(e) >= 2) & ~F.lower(e).isin("the", "a", "an", "is", "are"))
    return F.filter(found, lambda e, i: ~F.exists(F.slice(found, F.lit(1), i), lambda p: F.lower(p) == F.lower(e)))


def rewritten(query: Column) -> Column:
    """Without framing and politeness; null where nothing changes."""
    short = F.trim(F.regexp_replace(F.regexp_replace(query, f"(?i){FILLER_PREFIX}", ""), f"(?i){TRAILING_POLITENESS}", ""))
    return F.nullif(F.when(short == "", query).otherwise(short), query)


def coreference_resolved(query: Column) -> Column:
    """The first pronoun replaced by the query's first entity; null without both."""
    first = F.get(entities(query), F.lit(0))
    whole = F.regexp_extract(query, f"(?is)^(.*?){PRONOUN}(.*)$", 0)
    put = F.concat(F.regexp_extract(query, f"(?is)^(.*?){PRONOUN}(.*)$", 1), first, F.regexp_extract(query, f"(?is)^(.*?){PRONOUN}(.*)$", 3))
    return F.when(first.isNotNull() & (whole != ""), F.nullif(put, query))


def expanded(query: Column) -> Column:
    """The query with aliases of its known terms that it doesn't hold; null without any."""
    low = F.lower(query)
    extra = [F.when(low.contains(key) & ~low.contains(a), F.lit(a)) for key, names in ALIASES.items() for a in names]
    added = F.array_compact(F.array(*extra))
    return F.when(F.size(added) > 0, F.concat_ws(" ", query, F.array_join(added, " ")))


def decomposed(query: Column) -> Column:
    """The parts of a question, MOST_SUB_QUERIES at most: the two sides of a comparison, else what conjunctions join; null
    where that gives fewer than two."""
    sides = F.array(*[F.trim(F.regexp_extract(query, f"(?i){COMPARISON}", k)) for k in (1, 2)])
    joined = F.filter(F.transform(F.split(query, f"(?i){CONJUNCTION}"), F.trim), lambda part: part != "")
    parts = F.when(matches(query, COMPARISON), sides).otherwise(joined)
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, MOST_SUB_QUERIES))


def transformed(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    """Adds the variants that each query's analysis calls for; null where a transform doesn't apply or changes nothing. Wants
    needs_rewrite and multi_hop, as analysed() gives them."""
    asked = F.col(text_col)
    framed = F.coalesce("needs_rewrite", F.lit(False)) | matches(asked, FILLER_PREFIX)
    known = F.lower(asked).rlike("|".join(f"\\Q{term}\\E" for term in ALIASES))
    return queries.select(
        "*",
        F.when(framed, rewritten(asked)).alias("rewritten"),
        coreference_resolved(asked).alias("coreference"),
        expanded(asked).alias("expanded"),
        F.when(known, F.nullif(F.array_join(entities(asked), " "), F.lit(""))).alias("entities_only"),
        F.when(F.col("multi_hop"), decomposed(asked)).alias("sub_queries"),
    )


def plan_legs(queries: DataFrame, sources: list[tuple[str, bool, bool, int, bool]]) -> DataFrame:
    """Legs of each query: one for each source, with the variant that its capabilities call for, and sub-query legs for
    vector sources. `sources` are (id, text only, vector, top_k, required); queries have raw, rewritten, sub_queries and,
    where known, expanded, entities_only and coreference."""
    for c in ("expanded", "entities_only", "coreference"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast("string"))
    rows = F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(t).alias("text_only"), F.lit(v).alias("vector"), F.lit(k).alias("top_k"), F.lit(r).alias("required")) for s, t, v, k, r in sources])
    every = queries.withColumn("s", F.explode(rows)).select("*", "s.*").drop("s")
    words = F.when(F.col("text_only"), F.coalesce("expanded", "entities_only", "rewritten", "raw")).otherwise(F.coalesce("rewritten", "coreference", "raw"))
    main = every.select("query_id", "source_id", F.lit("main").alias("kind"), words.alias("text"), "top_k", "required")
    sub = every.where("vector").select("query_id", "source_id", F.lit("sub").alias("kind"), F.explode("sub_queries").alias("text"), F.greatest(F.expr("cast(top_k div 2 as int)"), F.lit(1)).alias("top_k"), F.lit(False).alias("required"))
    return main.union(sub)


def shrunk_quality(samples: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean quality of each bucket, pulled towards the prior by PRIOR_SAMPLES."""
    n = F.count(score)
    return samples.groupBy(*keys).agg(n.alias("n"), F.round(n / (n + PRIOR_SAMPLES) * F.avg(score) + PRIOR_SAMPLES / (n + PRIOR_SAMPLES) * PRIOR_QUALITY, 6).alias("quality"))


def routed(queries: DataFrame, weights: tuple[float, float, float] = (1.0, 0.3, 0.2)) -> DataFrame:
    """The strategy of greatest utility among those not ruled out. Queries have needs_retrieval, requires_* and uncertainty,
    wall_ms, usd, parametric_enabled, covered and tenant_covered."""
    gone = (
        F.when(~F.col("parametric_enabled"), "tenant_policy_forbids_parametric")
        .when(~F.col("covered"), "no_adapter_covers_this_domain")
        .when(F.coalesce("requires_live_data", F.lit(False)), "requires_live_data")
        .when(F.coalesce("requires_exact_quotation", F.lit(False)), "requires_exact_quotation")
        .when(F.coalesce("requires_private_data", F.lit(False)) & ~F.col("tenant_covered"), "requires_private_data_without_tenant_adapter")
    )
    idle = F.when(~F.col("needs_retrieval"), "no_external_knowledge_required")
    wq, wl, wc = weights

    def utility(latency, cost):
        return F.round(wq * PRIOR_QUALITY - wl * F.least(F.lit(1.0), latency / F.greatest(F.lit(1), "wall_ms")) - wc * F.least(F.lit(1.0), cost / F.greatest(F.lit(1e-9), "usd")), 6)

    options = F.array_compact(F.array(*[F.when((idle if name == "non_parametric" else gone).isNull(), F.struct(utility(F.lit(ms), F.lit(usd)).alias("utility"), F.lit(name).alias("name"))) for name, ms, usd in PROFILES]))
    best = F.array_max(options)
    rows = queries.withColumn("best", best)
    return rows.select(
        *queries.columns,
        F.coalesce("best.name", F.lit("non_parametric")).alias("strategy"),
        F.col("best.utility").alias("utility"),
        (F.col("best").isNull() | (F.col("uncertainty") > HEDGE_ABOVE)).alias("hedged"),
        gone.alias("parametric_eliminated"),
        idle.alias("non_parametric_eliminated"),
    )


def degradation_level(wall_left: Column, wall_total: Column, usd_left: Column, usd_total: Column) -> Column:
    """The rung of the ladder for the scarcer of time and money."""
    money = F.when(usd_total > 0, usd_left / usd_total).otherwise(1.0)
    scarcest = F.least(wall_left / wall_total, money)
    level = F.lit(0)
    for rung, share in LADDER:
        level = F.when(scarcest <= share, rung).otherwise(level)
    return level


def never_back(level: Column, by: list[str], order: list[str]) -> Column:
    """A level that never falls again along a request's steps."""
    return F.max(level).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def spent(steps: DataFrame, by: list[str], order: list[str], wall_total: Column, usd_total: Column) -> DataFrame:
    """What each step (wall_ms, usd) leaves of its request's budget: time never under zero, money spent so far, and whether
    either is used up. Null amounts count as nothing; negative ones are an error."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def running(amount: str) -> Column:
        taken = F.coalesce(amount, F.lit(0))
        return F.sum(F.when(taken < 0, F.raise_error(F.lit("spend amounts must not be negative")).cast("double")).otherwise(taken)).over(so_far)

    rows = steps.select("*", F.greatest(F.lit(0), wall_total - running("wall_ms")).alias("wall_left"), running("usd").alias("usd_spent"))
    return rows.withColumn("exhausted", (F.col("wall_left") <= 0) | (F.col("usd_spent") >= usd_total))


def cache_key(tier: str, tenant: Column, acl: Column, config: Column, embedding: Column, query: Column) -> Column:
    """Tier, tenant, sorted access labels, versions and the hash of the lower-cased, collapsed query, joined by pipes."""
    subject = F.sha2(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), 256)
    return F.concat_ws("|", F.lit(tier), tenant, F.array_join(F.array_sort(acl), ","), config, embedding, subject)


def cache_refusal(abstained: Column, coverage: Column, stale: Column, conflicts: Column, unsourced: Column) -> Column:
    """Why an answer may not be cached; null where it may."""
    return F.when(abstained, "abstained").when(coverage, "coverage_warning").when(stale, "staleness_warning").when(conflicts > 0, "validation_failed").when(unsourced > 0, "unsourced_claims")


def ttl_seconds(volatility: Column) -> Column:
    """Seconds that a volatility class may be cached; unknown classes count as fast."""
    known = F.create_map(*[F.lit(x) for kv in TTL_SECONDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, volatility), F.lit(TTL_SECONDS["fast"]))


def sampled(request_id: Column, rate: float) -> Column:
    """Whether a request is in the online sample: a stable hash under the rate."""
    return F.lit(rate > 0) & (F.conv(F.substring(F.sha2(request_id, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) < rate)
