"""Queries over the data side of serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import evaluation, grounding, serving
from querent.sources import catalog

from . import base
from .base import query
from .deciding import _GROUPS, _STANCE, _stance_sql, groups
from .remembering import _ITEMS, items
from .retrieval import _BM25, reranked


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'moved', n_chars + 2 FROM documents WHERE doc_id % 3 = 0")
def upsert_rows(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("moved").alias("source"), F.explode(F.array(F.col("n_chars") + 1, F.col("n_chars") + 2)).alias("n_chars")).withColumn("at", F.col("n_chars"))
    return serving.upserted(docs.where("doc_id % 2 = 0"), changes, ["doc_id"], "at")


@query(
    """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'tenant-' || event_id % 3 END AS tenant_id, CASE WHEN event_id % 2 = 0 THEN user_id::varchar ELSE 'anonymous' END AS user_id, CASE WHEN event_id % 4 = 0 THEN 'batch' ELSE 'standard' END AS sla_tier,
CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS n_acl, CASE WHEN event_id % 5 = 0 THEN 'tenant_assertion' END AS refusal FROM events"""
)
def principal_resolution(spark, sf_dir):
    n = F.col("event_id")
    pairs = F.array_compact(F.array(
        F.when(n % 5 > 0, F.struct(F.lit("x-tenant-id").alias("k"), F.concat(F.lit("tenant-"), (n % 3).cast("string")).alias("v"))),
        F.when(n % 2 == 0, F.struct(F.lit("x-user-id").alias("k"), F.col("user_id").cast("string").alias("v"))),
        F.struct(F.lit("x-sla-tier").alias("k"), F.when(n % 4 == 0, "batch").otherwise("odd").alias("v")),
        F.struct(F.lit("x-acl-hashes").alias("k"), F.when(n % 7 == 0, "a,,b").otherwise("a,").alias("v")),
    ))
    rows = catalog.table(spark, sf_dir, "events").select("event_id", F.map_from_entries(pairs).alias("headers"))
    return serving.principals(rows).select("event_id", "tenant_id", "user_id", "sla_tier", F.size("acl_hashes").alias("n_acl"), "refusal")


@query(
    """SELECT c_custkey AS tenant, CASE WHEN c_custkey % 3 = 0 THEN 'guardrails.checks' ELSE '' END AS disallowed, c_custkey % 2 = 0 AS strict_mode, CASE WHEN c_custkey % 5 = 0 THEN 4000 ELSE 8000 END AS max_evidence_tokens, c_custkey % 7 <> 0 AS parametric_enabled FROM customer"""
)
def tenant_policy(spark, sf_dir):
    n = F.col("c_custkey")
    pairs = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))) for c, k, v in ((n % 3 == 0, "guardrails.checks", "none"), (n % 2 == 0, "guardrails.strict_mode", "true"), (n % 5 == 0, "context.max_evidence_tokens", "4000"), (n % 7 == 0, "parametric.enabled", "false"))]))
    rows = catalog.table(spark, sf_dir, "customer").select(n.alias("tenant"), F.map_from_entries(pairs).alias("overrides"))
    return serving.tenant_policies(rows).select("tenant", F.array_join("disallowed", ",").alias("disallowed"), "strict_mode", "max_evidence_tokens", "parametric_enabled")


@query(
    """SELECT event_id, CASE WHEN (event_id % 3 > 0 OR event_id % 4 = 0) AND event_id % 7 < 4 THEN 'reasoning' ELSE 'default' END AS model,
CASE WHEN event_id % 31 = 0 THEN 'isolation_violation' WHEN event_type = 'error' THEN 'blocked' WHEN value < 20 THEN 'abstained' ELSE 'answered' END AS outcome FROM events"""
)
def model_and_outcome(spark, sf_dir):
    n = F.col("event_id")
    model = serving.model_choice(F.when(n % 3 > 0, "multi_step").otherwise("simple_factual"), F.when(n % 4 == 0, 1).otherwise(0), n % 7)
    return catalog.table(spark, sf_dir, "events").select("event_id", model.alias("model"), serving.outcome(n % 31 == 0, F.col("event_type") == "error", F.col("value") < 20).alias("outcome"))


@query(
    """SELECT event_id AS cache_key FROM events WHERE event_id % 4 > 0 AND 1704067200000 - (event_id % 50) * 100000 + (event_id % 4) * 900 * 1000 > 1704067200000
AND user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND user_id + 1 NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def cache_invalidation(spark, sf_dir):
    n = F.col("event_id")
    entries = catalog.table(spark, sf_dir, "events").select(n.alias("cache_key"), ((n % 4) * 900).alias("ttl_s"), (F.lit(catalog.CLOCK_MS) - (n % 50) * 100000).alias("stored_ms"), F.array("user_id", F.col("user_id") + 1).alias("document_ids"))
    return serving.cached(entries, catalog.CLOCK_MS, catalog.table(spark, sf_dir, "labels").where("toxic = 1")).select("cache_key")


@query(
    """SELECT user_id AS request_id, event_id AS step_no, event_type AS name, coalesce(sum(floor(value)::bigint) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_ms, floor(value)::bigint AS elapsed_ms, 1 AS n_attributes FROM events"""
)
def trace_spans(spark, sf_dir):
    steps = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("step_no"), F.col("event_type").alias("name"), F.floor("value").cast("long").alias("elapsed_ms"), F.create_map(F.lit("node"), F.col("event_type"), F.lit("query_text"), F.lit("x"), F.lit("prompt_hash"), F.lit("y")).alias("attributes"))
    return serving.spans(steps).select("request_id", "step_no", "name", "start_ms", "elapsed_ms", F.size("attributes").alias("n_attributes"))


_BOUNDS = evaluation.HISTOGRAM_BOUNDS


@query(
    "WITH h AS (SELECT event_type AS node, " + ", ".join(f"count_if(value <= {b}) AS le_{b}" for b in _BOUNDS) + ", count(*) AS le_inf FROM events GROUP BY 1), l AS (SELECT node, ["
    + ", ".join(f"'node_ms_bucket{{node=\"' || node || '\",le=\"{b}\"}} ' || le_{b}" for b in _BOUNDS)
    + """, 'node_ms_bucket{node="' || node || '",le="+Inf"} ' || le_inf, 'node_ms_count{node="' || node || '"} ' || le_inf] AS ls FROM h) SELECT node, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l"""
)
def metrics_text(spark, sf_dir):
    rows = evaluation.histogram(catalog.table(spark, sf_dir, "events").withColumnRenamed("event_type", "node"), "value", ["node"])
    return serving.metric_lines(rows, "node_ms", "node", _BOUNDS).select("node", "line", F.col("line_no").cast("long").alias("line_no"))


@query()
def trim_memory(spark, sf_dir):
    """A fold that skips what doesn't fit is beyond SQL; tests hold the brute force."""
    return serving.trimmed_memory(items(spark, sf_dir), "session_id", 120)


@query(_BM25 + "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at_ms, chunk_id) - 1 AS chronological, row_number() OVER (PARTITION BY query_id ORDER BY source_id, rerank_score DESC, chunk_id) - 1 AS by_source FROM final JOIN docs ON doc_id = chunk_id")
def evidence_orders(spark, sf_dir):
    w = Window.partitionBy("query_id")
    return reranked(spark, sf_dir).select(
        "query_id", "chunk_id",
        (F.row_number().over(w.orderBy("updated_at_ms", "chunk_id")) - 1).cast("long").alias("chronological"),
        (F.row_number().over(w.orderBy("source_id", F.desc("rerank_score"), "chunk_id")) - 1).cast("long").alias("by_source"),
    )


@query(
    f"""{_GROUPS}, cl AS (SELECT query_id, 0 AS n, query_text || ' is not 45 days' AS text FROM queries), ca AS (SELECT query_id, n, {_stance_sql("text")} AS a FROM cl WHERE length(trim(text)) >= 12),
sn AS (SELECT query_id, place, list_filter(list_transform({base.sentences("text")}, lambda s: trim(s)), lambda s: length(s) > 12) AS ss FROM gr), sx AS (SELECT query_id, place, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS k FROM sn),
sp AS MATERIALIZED (SELECT *, {_stance_sql("s")} AS b FROM sx), pr AS (SELECT query_id, n, place, k, s, {_STANCE} AS st FROM ca JOIN sp USING (query_id)),
ok AS (SELECT query_id, n FROM pr GROUP BY ALL HAVING NOT coalesce(bool_or(st = 'supports'), false))
SELECT query_id, n, place, s AS excerpt FROM pr JOIN ok USING (query_id, n) WHERE st = 'contradicts' QUALIFY row_number() OVER (PARTITION BY query_id, n ORDER BY place, k) = 1"""
)
def parametric_conflicts(spark, sf_dir):
    claims = catalog.queries(spark, sf_dir).select("query_id", F.lit(0).alias("n"), F.concat("query_text", F.lit(" is not 45 days")).alias("text"))
    parts = F.filter(F.transform(text.sentences(F.col("text")), lambda s: F.trim(s)), lambda s: F.length(s) > 12)
    rows = groups(spark, sf_dir).select("query_id", F.col("place").cast("long").alias("place"), F.posexplode(parts).alias("k", "s"))
    return serving.parametric_conflicts(claims, rows)


@query(
    """WITH a AS (SELECT user_id AS request_id, event_id AS adapter_id, round(value / 100, 4) AS coverage, (event_id % 10) / 10.0::double AS score FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coverage DESC, adapter_id) AS k FROM a QUALIFY k <= 2),
s AS (SELECT request_id, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2, max(CASE WHEN k = 1 THEN adapter_id END) AS a1, max(CASE WHEN k = 2 THEN adapter_id END) AS a2 FROM k GROUP BY 1)
SELECT request_id, CASE WHEN s1 < 0.6 AND coalesce(s2 > s1, false) THEN a2 ELSE a1 END AS adapter_id, CASE WHEN s1 < 0.6 AND coalesce(s2 > s1, false) THEN s2 ELSE s1 END AS score FROM s"""
)
def serving_composition(spark, sf_dir):
    n = F.col("event_id")
    rows = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), n.alias("adapter_id"), F.round(F.col("value") / 100, 4).alias("coverage"), ((n % 10) / F.lit(10.0)).alias("score"), F.lit("").alias("answer"))
    return serving.composed(rows)


@query("SELECT source, CASE WHEN age > 365 THEN 'expired' WHEN age > 360 THEN 'stale' WHEN age > 180 THEN 'aging' ELSE 'fresh' END AS state, n FROM (SELECT source, min(doc_id) + max(doc_id) % 400 AS age, count(*) AS n FROM documents GROUP BY 1)")
def source_staleness(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "documents").groupBy("source").agg((F.min("doc_id") + F.max("doc_id") % 400).alias("age"), F.count(F.lit(1)).alias("n"))
    return rows.select("source", serving.staleness_state(F.col("age"), F.lit(180), F.lit(365)).alias("state"), "n")


@query("SELECT event_type AS run, max_by(event_id, ts::varchar || lpad(event_id::varchar, 9, '0')) AS latest, count(*) AS n FROM events GROUP BY 1")
def latest_run(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("run")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT concat_ws('.', source, lang) AS source_id FROM documents), h AS (SELECT concat_ws('.', source, lang) AS source_id, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY 1)
SELECT source_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'degraded' ELSE 'healthy' END AS state FROM s LEFT JOIN h USING (source_id)"""
)
def source_health(spark, sf_dir):
    """Sources by language, over an index that holds what is labelled good and not toxic."""
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("source_id"))
    held = docs.join(catalog.table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    return serving.health(docs, held, "source_id")
