"""Data side of serving: stores, principals, policies, models, caches, outcomes, traces and metric text as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators.fusion import stance, stance_parts
from querent.operators.grounding import substantive

TIERS = ("interactive", "standard", "high_stakes", "batch")
#: Keys that a tenant may override, and attribute names that traces don't carry.
ALLOWED_OVERRIDES = ("routing.utility_weights", "guardrails.strict_mode", "context.max_evidence_tokens", "fusion.abstain_below_knowledge_score", "caching.tiers.semantic.similarity_floor", "parametric.enabled")
SENSITIVE = "query_text|evidence_text|answer_text|prompt"


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after changes: the last change of each key wins, other rows stay."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), order).alias("row")).select(*keys, "row.*")
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*current.columns))


def principals(requests: DataFrame, headers: str = "headers") -> DataFrame:
    """Who asks, from a map of header names and values; no tenant is a refusal, an unknown tier counts as standard."""
    get = lambda k: F.try_element_at(F.col(headers), F.lit(k))
    parts = lambda k: F.filter(F.split(F.coalesce(get(k), F.lit("")), ","), lambda x: x != "")
    tier = F.coalesce(get("x-sla-tier"), F.lit("standard"))
    return requests.withColumns({
        "tenant_id": F.nullif(get("x-tenant-id"), F.lit("")),
        "user_id": F.coalesce(get("x-user-id"), F.lit("anonymous")),
        "groups": parts("x-groups"),
        "acl_hashes": parts("x-acl-hashes"),
        "sla_tier": F.when(tier.isin(*TIERS), tier).otherwise("standard"),
        "refusal": F.when(F.coalesce(get("x-tenant-id"), F.lit("")) == "", "tenant_assertion"),
    })


def tenant_policies(tenants: DataFrame, strict: bool = False, evidence_tokens: int = 8000, parametric: bool = True) -> DataFrame:
    """Policy of each tenant from platform defaults and its overrides (a map of strings); disallowed keys are listed and refuse
    the policy. A tenant can turn the parametric tier off, never on."""
    get = lambda k: F.try_element_at(F.col("overrides"), F.lit(k))
    bad = F.array_sort(F.filter(F.map_keys("overrides"), lambda k: ~k.isin(*ALLOWED_OVERRIDES)))
    return tenants.withColumns({
        "disallowed": bad,
        "strict_mode": F.coalesce(get("guardrails.strict_mode").cast("boolean"), F.lit(strict)),
        "max_evidence_tokens": F.coalesce(get("context.max_evidence_tokens").cast("int"), F.lit(evidence_tokens)),
        "parametric_enabled": F.lit(parametric) & F.coalesce(get("parametric.enabled").cast("boolean"), F.lit(True)),
    })


def model_choice(complexity: Column, conflicts: Column, level: Column) -> Column:
    """The reasoning model for what isn't simple, unless the budget's rung forbids it."""
    return F.when(((complexity != "simple_factual") | (conflicts > 0)) & (level < 4), "reasoning").otherwise("default")


def outcome(isolation: Column, blocked: Column, abstained: Column) -> Column:
    return F.when(isolation, "isolation_violation").when(blocked, "blocked").when(abstained, "abstained").otherwise("answered")


def cached(entries: DataFrame, now_ms: int, changed_documents: DataFrame) -> DataFrame:
    """Entries that still hold: stored with a positive ttl, not expired, and built on no changed document."""
    live = entries.where((F.col("ttl_s") > 0) & (F.col("stored_ms") + F.col("ttl_s") * 1000 > now_ms))
    gone = live.select("cache_key", F.explode("document_ids").alias("doc_id")).join(changed_documents.select("doc_id").distinct(), "doc_id", "left_semi").select("cache_key").distinct()
    return live.join(gone, "cache_key", "left_anti")


def spans(steps: DataFrame) -> DataFrame:
    """Sequential spans of each request's steps (request_id, step_no, name, elapsed_ms, attributes): starts are running sums,
    sensitive attributes are left out."""
    before = Window.partitionBy("request_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    safe = F.map_filter("attributes", lambda k, _: ~k.rlike(SENSITIVE))
    return steps.select("request_id", "step_no", "name", F.coalesce(F.sum("elapsed_ms").over(before), F.lit(0)).alias("start_ms"), "elapsed_ms", safe.alias("attributes"))


def metric_lines(histograms: DataFrame, name: str, label: str, bounds) -> DataFrame:
    """Text lines of cumulative histograms (columns le_<bound>, le_inf, total) for each label value."""
    value = F.concat(F.lit(f'{{{label}="'), F.regexp_replace(F.col(label), r'(["\\])', r"\\$1"), F.lit('"'))
    rows = [F.concat(F.lit(f"{name}_bucket"), value, F.lit(f',le="{b}"}} '), F.col(f"le_{b}").cast("string")) for b in bounds]
    rows += [F.concat(F.lit(f"{name}_bucket"), value, F.lit(',le="+Inf"} '), F.col("le_inf").cast("string")), F.concat(F.lit(f"{name}_count"), value, F.lit("} "), F.col("le_inf").cast("string"))]
    return histograms.select(label, F.posexplode(F.array(*rows)).alias("line_no", "line"))


def trimmed_memory(items: DataFrame, by: str, cap: int | str) -> DataFrame:
    """Items that fit in the cap (tokens, or the column that holds them for each group), the most salient first; one that doesn't fit is left out and later ones are still tried."""
    row = F.struct((-F.col("salience")).alias("k"), "created_at_ms", "item_id", text.token_estimate(F.col("text")).alias("cost"))
    most = F.lit(cap) if isinstance(cap, int) else F.max(cap)
    pools = items.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("items"), most.alias("most"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= F.col("most")
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["kept"], x["item_id"])).otherwise(s["kept"]).alias("kept"))

    return pools.select(by, F.aggregate("items", start, step).alias("s")).select(by, "s.used", "s.kept")


def parametric_conflicts(claims: DataFrame, sentences: DataFrame) -> DataFrame:
    """Claims (query_id, n, text) that some evidence sentence (query_id, place, k, s) contradicts and none supports, with the
    first that contradicts."""
    a = claims.where(substantive(F.col("text"))).withColumn("a", stance_parts(F.col("text")))
    b = sentences.withColumn("b", stance_parts(F.col("s")))
    pairs = a.join(b, "query_id").withColumn("stance", stance(F.col("a"), F.col("b")))
    against = F.col("stance") == "contradicts"
    found = pairs.groupBy("query_id", "n").agg(F.coalesce(F.bool_or(F.col("stance") == "supports"), F.lit(False)).alias("backed"), F.min(F.when(against, F.struct("place", "k", "s"))).alias("first"))
    return found.where(~F.col("backed") & F.col("first").isNotNull()).select("query_id", "n", F.col("first.place").alias("place"), F.col("first.s").alias("excerpt"))


def composed(answers: DataFrame, below: float = 0.6) -> DataFrame:
    """The answer of a request's adapters (request_id, adapter_id, coverage, score, answer) by sequential probing: the best
    covered one's, unless its score is under `below` and the second's is higher."""
    order = Window.partitionBy("request_id").orderBy(F.desc("coverage"), "adapter_id")
    rows = answers.withColumn("k", F.row_number().over(order)).where("k <= 2")
    sides = rows.groupBy("request_id").agg(*[F.max(F.when(F.col("k") == k, F.struct("score", "answer", "adapter_id"))).alias(f"r{k}") for k in (1, 2)])
    second = (F.col("r1.score") < below) & F.coalesce(F.col("r2.score") > F.col("r1.score"), F.lit(False))
    pick = F.when(second, F.col("r2")).otherwise(F.col("r1"))
    return sides.select("request_id", pick["adapter_id"].alias("adapter_id"), pick["score"].alias("score"))


def merged_weights(answers: DataFrame) -> DataFrame:
    """The answer of a request's adapters (request_id, adapter_id, coverage, score, answer) by weighted merge: all are asked,
    each score counts by its adapter's coverage, and equal ones go to the greater answer."""
    best = F.max(F.struct(F.round(F.col("coverage") * F.col("score"), 6).alias("score"), "answer", "adapter_id"))
    return answers.groupBy("request_id").agg(best.alias("b")).select("request_id", "b.adapter_id", "b.score", "b.answer")


def health(sources: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """State of each source's index: degraded where it is empty, as that answers everything with nothing."""
    n = held.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    rows = sources.select(by).distinct().join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("state", F.when(F.col("n") == 0, "degraded").otherwise("healthy"))


def staleness_state(age_days: Column, half_life: Column, ttl_days: Column) -> Column:
    return F.when(age_days > ttl_days, "expired").when(age_days > 2 * half_life, "stale").when(age_days > half_life, "aging").otherwise("fresh")
