"""Queries over query intelligence, budgets and caching."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.operators import intelligence as ai
from querent.sources import catalog

from .base import query


def _q(p):
    return p.replace("'", "''")


_ASK = """asked AS (SELECT conv_id * 100 + turn AS query_id, CASE turn % 9 WHEN 0 THEN 'Please compare ' || t || ' and Sev-2 rotas for our team' WHEN 1 THEN 'hello' WHEN 2 THEN 'what is 12 * 7 of ' || t WHEN 3 THEN 'Summarize this text ' || t WHEN 4 THEN 'current price of ' || t || ' right now please'
  WHEN 5 THEN 'quote the SLA verbatim, which document says it' WHEN 6 THEN 'tell me who will escalate sev-1 for Acme Corp' ELSE t END AS query_text FROM (SELECT *, regexp_replace(text, '[^ -~]', 'x', 'g') AS t FROM conversations))"""


def asked(spark, sf_dir):
    t, k = F.regexp_replace("text", "[^ -~]", "x"), F.col("turn") % 9
    made = (
        F.when(k == 0, F.concat(F.lit("Please compare "), t, F.lit(" and Sev-2 rotas for our team")))
        .when(k == 1, "hello")
        .when(k == 2, F.concat(F.lit("what is 12 * 7 of "), t))
        .when(k == 3, F.concat(F.lit("Summarize this text "), t))
        .when(k == 4, F.concat(F.lit("current price of "), t, F.lit(" right now please")))
        .when(k == 5, "quote the SLA verbatim, which document says it")
        .when(k == 6, "tell me who will escalate sev-1 for Acme Corp")
        .otherwise(t)
    )
    return catalog.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), made.alias("query_text"))


_H = {k: f"regexp_matches(query_text, '(?i){_q(p)}')" for k, p in {"ar": ai.ARITHMETIC, "se": ai.SELF_REFERENTIAL, "ve": ai.TRANSFORM_VERB, "li": ai.LIVE_DATA, "qu": ai.EXACT_QUOTATION, "pr": ai.PRIVATE_SCOPE, "ci": ai.CITATION_DEMAND, "mu": ai.MULTI_HOP, "gr": ai.GREETING, "pn": ai.PRONOUN, "qw": ai.QUESTION_WORD}.items()}
_RULES = f"""{_ASK}, h AS (SELECT *, {", ".join(f"{p} AS {k}" for k, p in _H.items())}, len(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda w: w <> '')) AS nw FROM asked),
f AS (SELECT *, CASE WHEN gr THEN 'conversational' WHEN ve AND se THEN 'transformation' WHEN ar THEN 'computation' END AS intent, CASE WHEN gr THEN 'trivial' WHEN mu THEN 'multi_step' WHEN (ve AND se) OR ar THEN 'simple_factual' END AS complexity,
  CASE WHEN gr THEN false WHEN pr OR li THEN true WHEN se OR ar THEN false END AS ext, CASE WHEN gr THEN false WHEN li THEN true END AS live, CASE WHEN gr THEN false WHEN pr THEN true END AS priv, CASE WHEN gr THEN NULL WHEN qu THEN true END AS quo,
  CASE WHEN gr THEN false WHEN ci OR qu THEN true WHEN se OR ar THEN false END AS cit, CASE WHEN gr THEN false WHEN mu THEN true END AS hop, CASE WHEN NOT gr AND li THEN 'realtime' END AS vol FROM h),
r AS (SELECT *, CASE WHEN gr THEN 1.0::double ELSE least(1.0, ((intent IS NOT NULL)::int + (complexity IS NOT NULL)::int + (ext IS NOT NULL)::int + (live IS NOT NULL)::int + (priv IS NOT NULL)::int + (quo IS NOT NULL)::int + (cit IS NOT NULL)::int + (hop IS NOT NULL)::int + (vol IS NOT NULL)::int) / 8.0::double) END AS coverage FROM f)
"""


@query(
    f"""WITH {_RULES} SELECT query_id, intent, complexity, ext AS requires_external_knowledge, priv AS requires_private_data, cit AS requires_citation, coverage, round(1 - coverage, 3) AS uncertainty,
CASE coalesce(vol, 'slow') WHEN 'realtime' THEN 0.04::double ELSE 180.0::double END AS half_life_days, CASE WHEN pn THEN 'unresolved_reference' WHEN nw <= 2 AND NOT qw THEN 'underspecified' ELSE 'none' END AS ambiguity,
CASE WHEN nw >= 6 AND NOT pn THEN 0.9::double WHEN nw >= 4 THEN 0.55::double ELSE 0.3::double END AS quality FROM r"""
)
def rules_classifier(spark, sf_dir):
    return ai.analysed(asked(spark, sf_dir)).select("query_id", "intent", "complexity", "requires_external_knowledge", "requires_private_data", "requires_citation", "coverage", "uncertainty", "half_life_days", "ambiguity", "quality")


_REWRITE = f"trim(regexp_replace(regexp_replace(query_text, '(?i){_q(ai.FILLER_PREFIX)}', ''), '(?i){_q(ai.TRAILING_POLITENESS)}', ''))"
_ALIASES = ", ".join(f"CASE WHEN contains(lower(query_text), '{k}') AND NOT contains(lower(query_text), '{a}') THEN '{a}' END" for k, names in ai.ALIASES.items() for a in names)


@query(
    f"""WITH {_ASK}, e AS (SELECT *, list_filter(regexp_extract_all(query_text, '{ai.ENTITY}'), lambda x: length(x) >= 2 AND lower(x) NOT IN ('the', 'a', 'an', 'is', 'are')) AS es, list_filter([{_ALIASES}], lambda x: x IS NOT NULL) AS al FROM asked)
SELECT query_id, nullif(CASE WHEN {_REWRITE} = '' THEN query_text ELSE {_REWRITE} END, query_text) AS rewritten, array_to_string(list_filter(es, lambda x, i: NOT list_contains(list_transform(es[1:i - 1], lambda y: lower(y)), lower(x))), '|') AS entities,
CASE WHEN len(al) > 0 THEN query_text || ' ' || array_to_string(al, ' ') END AS expanded, CASE WHEN len(es) > 0 AND regexp_matches(query_text, '(?i){ai.PRONOUN}') THEN nullif(regexp_replace(query_text, '(?i){ai.PRONOUN}', es[1]), query_text) END AS coreference FROM e"""
)
def query_variants(spark, sf_dir):
    t = F.col("query_text")
    return asked(spark, sf_dir).select("query_id", ai.rewritten(t).alias("rewritten"), F.array_join(ai.entities(t), "|").alias("entities"), ai.expanded(t).alias("expanded"), ai.coreference_resolved(t).alias("coreference"))


_SPLIT = f"regexp_replace(regexp_replace(query_text, '(?i)\\s+(?:and then|and also|as well as|;)\\s+', chr(1), 'g'), '(?i)\\s+and\\s+(how|what|when|where|why|who|which)', chr(1) || '\\1', 'g')"
_PARTS = f"""CASE WHEN regexp_matches(query_text, '(?i){ai.COMPARISON}') THEN [trim(regexp_extract(query_text, '(?i){ai.COMPARISON}', 1)), trim(regexp_extract(query_text, '(?i){ai.COMPARISON}', 2))]
  ELSE list_filter(list_transform(string_split({_SPLIT}, chr(1)), lambda x: trim(x)), lambda x: x <> '') END"""
_KNOWN = " OR ".join(f"contains(lower(query_text), '{k}')" for k in ai.ALIASES)


@query(
    f"""WITH {_RULES}, e AS (SELECT *, list_filter(regexp_extract_all(query_text, '{ai.ENTITY}'), lambda x: length(x) >= 2 AND lower(x) NOT IN ('the', 'a', 'an', 'is', 'are')) AS es, list_filter([{_ALIASES}], lambda x: x IS NOT NULL) AS al, {_PARTS} AS parts FROM r)
SELECT query_id, CASE WHEN nw < 4 OR regexp_matches(query_text, '(?i){_q(ai.FILLER_PREFIX)}') THEN nullif(CASE WHEN {_REWRITE} = '' THEN query_text ELSE {_REWRITE} END, query_text) END AS rewritten,
CASE WHEN len(es) > 0 AND pn THEN nullif(regexp_replace(query_text, '(?i){ai.PRONOUN}', es[1]), query_text) END AS coreference, CASE WHEN len(al) > 0 THEN query_text || ' ' || array_to_string(al, ' ') END AS expanded,
CASE WHEN {_KNOWN} THEN nullif(array_to_string(list_filter(es, lambda x, i: NOT list_contains(list_transform(es[1:i - 1], lambda y: lower(y)), lower(x))), ' '), '') END AS entities_only,
CASE WHEN hop AND len(parts) >= 2 THEN array_to_string(parts[1:6], '|') END AS sub_queries FROM e"""
)
def query_transforms(spark, sf_dir):
    rows = ai.transformed(ai.analysed(asked(spark, sf_dir)))
    return rows.select("query_id", "rewritten", "coreference", "expanded", "entities_only", F.array_join("sub_queries", "|").alias("sub_queries"))


@query("SELECT source, lang, count(quality) AS n, round(count(quality) / (count(quality) + 20.0::double) * avg(quality) + 20.0::double / (count(quality) + 20.0::double) * 0.62::double, 6) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def quality_shrinkage(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "labels").join(catalog.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return ai.shrunk_quality(rows, ["source", "lang"], "quality")


def _u(ms, usd):
    return f"round(1.0::double * 0.62::double - 0.3::double * least(1.0, {ms}::double / wall_ms) - 0.2::double * least(1.0, {usd}::double / usd), 6)"


@query(
    f"""WITH {_RULES}, b AS (SELECT *, 500 + (query_id % 7) * 400 AS wall_ms, 0.001::double + 0.002::double * (query_id % 5) AS usd, query_id % 4 > 0 AS pe, query_id % 3 > 0 AS cv, query_id % 2 = 0 AS tc, round(1 - coverage, 3) AS uncertainty FROM r),
g AS (SELECT *, CASE WHEN NOT pe THEN 'tenant_policy_forbids_parametric' WHEN NOT cv THEN 'no_adapter_covers_this_domain' WHEN coalesce(live, false) THEN 'requires_live_data' WHEN coalesce(quo, false) THEN 'requires_exact_quotation' WHEN coalesce(priv, false) AND NOT tc THEN 'requires_private_data_without_tenant_adapter' END AS gone,
  CASE WHEN NOT coalesce(ext, true) THEN 'no_external_knowledge_required' END AS idle FROM b),
o AS (SELECT *, list_filter([CASE WHEN gone IS NULL THEN {{'u': {_u(420.0, 0.0016)}, 'n': 'parametric'}} END, CASE WHEN idle IS NULL THEN {{'u': {_u(1150.0, 0.0043)}, 'n': 'non_parametric'}} END, CASE WHEN gone IS NULL THEN {{'u': {_u(1380.0, 0.0057)}, 'n': 'hybrid'}} END], lambda x: x IS NOT NULL) AS os FROM g),
m AS (SELECT *, list_max(os) AS best FROM o)
SELECT query_id, coalesce(best.n, 'non_parametric') AS strategy, best.u AS utility, best IS NULL OR uncertainty > 0.35 AS hedged, gone AS parametric_eliminated, idle AS non_parametric_eliminated FROM m"""
)
def strategy_route(spark, sf_dir):
    n = F.col("query_id")
    rows = ai.analysed(asked(spark, sf_dir)).select("*", (500 + (n % 7) * 400).alias("wall_ms"), (F.lit(0.001) + F.lit(0.002) * (n % 5)).alias("usd"), (n % 4 > 0).alias("parametric_enabled"), (n % 3 > 0).alias("covered"), (n % 2 == 0).alias("tenant_covered"))
    return ai.routed(rows).select("query_id", "strategy", "utility", "hedged", "parametric_eliminated", "non_parametric_eliminated")


@query(
    """WITH s AS (SELECT user_id AS request_id, event_id, least((1 - (event_id % 97) / 100.0::double), 1 - (event_id % 53) / 60.0::double) AS left_share FROM events),
l AS (SELECT *, CASE WHEN left_share <= 0 THEN 6 WHEN left_share <= 0.08 THEN 5 WHEN left_share <= 0.15 THEN 4 WHEN left_share <= 0.25 THEN 3 WHEN left_share <= 0.35 THEN 2 WHEN left_share <= 0.5 THEN 1 ELSE 0 END AS lv FROM s)
SELECT request_id, event_id, max(lv) OVER (PARTITION BY request_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS level FROM l"""
)
def degradation_level(spark, sf_dir):
    n = F.col("event_id")
    rows = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), "event_id", ai.degradation_level(1 - (n % 97) / F.lit(100.0), F.lit(1.0), 1 - (n % 53) / F.lit(60.0), F.lit(1.0)).alias("now"))
    return rows.select("request_id", "event_id", ai.never_back(F.col("now"), ["request_id"], ["event_id"]).alias("level"))


@query("SELECT conv_id, turn, concat_ws('|', 'answer', 'tenant-' || conv_id % 3, CASE WHEN turn % 2 = 0 THEN 'acl-eng,public' ELSE 'acl-a,acl-z' END, 'cfg1', 'emb1', sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS cache_key FROM conversations")
def cache_keys(spark, sf_dir):
    acl = F.when(F.col("turn") % 2 == 0, F.array(F.lit("public"), F.lit("acl-eng"))).otherwise(F.array(F.lit("acl-z"), F.lit("acl-a")))
    key = ai.cache_key("answer", F.concat(F.lit("tenant-"), (F.col("conv_id") % 3).cast("string")), acl, F.lit("cfg1"), F.lit("emb1"), F.col("text"))
    return catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("cache_key"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'abstained' WHEN event_id % 5 = 0 THEN 'coverage_warning' WHEN event_id % 11 = 0 THEN 'staleness_warning' WHEN event_id % 3 > 1 THEN 'validation_failed' WHEN event_id % 13 = 0 THEN 'unsourced_claims' END AS refusal,
CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 14400 WHEN 'error' THEN 0 ELSE 900 END AS ttl FROM events"""
)
def cacheability(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    refusal = ai.cache_refusal(n % 7 == 0, n % 5 == 0, n % 11 == 0, F.when(n % 3 > 1, 1).otherwise(0), F.when(n % 13 == 0, 1).otherwise(0))
    volatility = F.when(kind == "click", "static").when(kind == "view", "slow").when(kind == "error", "realtime").otherwise("other")
    return catalog.table(spark, sf_dir, "events").select("event_id", refusal.alias("refusal"), ai.ttl_seconds(volatility).alias("ttl"))


@query("SELECT event_id FROM events WHERE ('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint / 4294967296.0::double < 0.1")
def online_sample(spark, sf_dir):
    """A sampling operator: the members are those of a stable hash."""
    return catalog.table(spark, sf_dir, "events").where(ai.sampled(F.col("event_id").cast("string"), 0.1)).select("event_id")


@query(
    """WITH s AS (SELECT user_id, event_id, greatest(0, 2000 - sum(value) OVER w) AS wall_left, sum(value / 1000) OVER w AS usd_spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, round(wall_left, 6) AS wall_left, round(usd_spent, 6) AS usd_spent, wall_left <= 0 OR usd_spent >= 1 AS exhausted FROM s"""
)
def budget_spend(spark, sf_dir):
    """Each user's events as the steps of a request, their value its time."""
    steps = catalog.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").alias("wall_ms"), (F.col("value") / 1000).alias("usd"))
    rows = ai.spent(steps, ["user_id"], ["ts", "event_id"], F.lit(2000.0), F.lit(1.0))
    return rows.select("user_id", "event_id", F.round("wall_left", 6).alias("wall_left"), F.round("usd_spent", 6).alias("usd_spent"), "exhausted")
