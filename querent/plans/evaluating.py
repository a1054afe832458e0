"""Queries over evaluation, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import evaluation, grounding
from querent.sources import catalog

from . import base
from .base import query
from .grounding import _ANSWER, answers, evidence_rows
from .retrieval import _BM25, _bm25_top, counted, relevance, reranked

_SAMPLES = (
    _ANSWER
    + """, sm AS (SELECT q.query_id, answer, starts_with(answer, 'The retrieved') OR starts_with(answer, 'I do not') AS abstained, (SELECT count(*) FROM labels l WHERE l.query_id = q.query_id) AS n_rel FROM queries q JOIN ans USING (query_id)),
mt AS (SELECT query_id, 'abstention_correct' AS metric_id, ((n_rel = 0) = abstained)::int::double AS score, false AS judged FROM sm UNION ALL
  SELECT query_id, 'answered', CASE WHEN NOT abstained THEN 1.0::double END, false FROM sm UNION ALL
  SELECT query_id, 'citation_density', CASE WHEN NOT abstained THEN round(len(regexp_extract_all(answer, '\\[E\\d+\\]'))::double / 3, 6) END, true FROM sm),
card AS (SELECT metric_id, round(avg(score), 6) AS mean, count(*) AS n, round(avg((score >= 0.5)::int), 6) AS pass_rate, bool_or(judged) AS judged FROM mt WHERE score IS NOT NULL GROUP BY 1)
"""
)


def samples(spark, sf_dir):
    held = counted(spark, sf_dir)
    labels = relevance(spark, sf_dir, held).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = answers(spark, sf_dir, evidence_rows(spark, sf_dir, held)).join(labels, "query_id", "left").na.fill(0, ["n_rel"])
    gone = F.col("answer").startswith("The retrieved") | F.col("answer").startswith("I do not")
    cited = F.round(F.size(F.regexp_extract_all("answer", F.lit(r"\[E\d+\]"), F.lit(0))) / F.lit(3.0), 6)
    made = F.array(
        F.struct(F.lit("abstention_correct").alias("metric_id"), ((F.col("n_rel") == 0) == gone).cast("double").alias("score"), F.lit(False).alias("judged")),
        F.struct(F.lit("answered").alias("metric_id"), F.when(~gone, 1.0).alias("score"), F.lit(False).alias("judged")),
        F.struct(F.lit("citation_density").alias("metric_id"), F.when(~gone, cited).alias("score"), F.lit(True).alias("judged")),
    )
    return rows.select("query_id", F.explode(made).alias("m")).select("query_id", "m.*").withColumn("passed", F.col("score") >= 0.5)


@query(_SAMPLES + "SELECT query_id, metric_id, score FROM mt")
def answer_metrics(spark, sf_dir):
    return samples(spark, sf_dir).select("query_id", "metric_id", "score")


@query(_SAMPLES + "SELECT * FROM card")
def scorecard(spark, sf_dir):
    return evaluation.scorecard(samples(spark, sf_dir))


@query(
    _SAMPLES
    + """, fl(metric_id, floor, before) AS (VALUES ('abstention_correct', 0.9::double, 0.95::double), ('citation_density', 0.99::double, 1.0::double), ('answered', 0.5::double, 0.99::double), ('absent', 0.5::double, NULL)),
g AS (SELECT f.metric_id, floor, mean, CASE WHEN mean IS NULL THEN ['missing'] WHEN coalesce(judged, false) THEN [] ELSE list_filter([CASE WHEN mean < floor THEN 'below_floor' END, CASE WHEN mean < before - 0.02::double THEN 'regressed' END], lambda x: x IS NOT NULL) END AS why, NOT coalesce(judged, false) AS gated FROM fl f LEFT JOIN card USING (metric_id))
SELECT metric_id, floor, mean, array_to_string(why, ',') AS reasons, len(why) = 0 AS passed, gated FROM g"""
)
def regression_gate(spark, sf_dir):
    card = evaluation.scorecard(samples(spark, sf_dir))
    floors = spark.createDataFrame([("abstention_correct", 0.9), ("citation_density", 0.99), ("answered", 0.5), ("absent", 0.5)], "metric_id string, floor double")
    before = spark.createDataFrame([("abstention_correct", 0.95), ("citation_density", 1.0), ("answered", 0.99)], "metric_id string, mean double")
    return evaluation.regression_gate(card, before, floors, F.lit(False))


@query("SELECT source, count(*) AS n, round(avg(((least(1.0, n_chars / 4000.0) >= 0.5) = (quality = 1))::int), 6) AS agreement, count(*) >= 50 AND round(avg(((least(1.0, n_chars / 4000.0) >= 0.5) = (quality = 1))::int), 6) >= 0.8 AS calibrated FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def judge_agreement(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "labels").join(catalog.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rate = F.round(F.avg(((F.least(F.lit(1.0), F.col("n_chars") / 4000.0) >= 0.5) == (F.col("quality") == 1)).cast("double")), 6)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rate.alias("agreement"), ((F.count(F.lit(1)) >= 50) & (rate >= 0.8)).alias("calibrated"))


@query("SELECT event_type AS node, " + ", ".join(f"count_if(value <= {b}) AS le_{b}" for b in evaluation.HISTOGRAM_BOUNDS) + ", count(*) AS le_inf, round(sum(value), 2) AS total FROM events GROUP BY 1")
def latency_histogram(spark, sf_dir):
    return evaluation.histogram(catalog.table(spark, sf_dir, "events").withColumnRenamed("event_type", "node"), "value", ["node"])


@query(
    """WITH w AS (SELECT user_id % 10 AS tenant, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS starts, round(avg((event_type = 'error')::int), 6) AS ratio, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM w WHERE ratio > 0.05"""
)
def alert_ratios(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").withColumn("tenant", F.col("user_id") % 10)
    found = evaluation.alert_ratios(rows, F.col("event_type") == "error", "ts", ["tenant"], "1 day", 0.05)
    return found.withColumn("starts", F.col("starts").cast("timestamp_ntz"))


_BOUNDS = evaluation.HISTOGRAM_BOUNDS
_INSIDE = " ".join(f"WHEN c{k} >= 0.95::double * n THEN coalesce({float(([0] + list(_BOUNDS))[k])}::double + {b - ([0] + list(_BOUNDS))[k]} * (0.95::double * n - {f'c{k - 1}' if k else 0}) / nullif(c{k} - {f'c{k - 1}' if k else 0}, 0), {float(b)}::double)" for k, b in enumerate(_BOUNDS))


@query(
    f"""WITH x AS (SELECT event_type AS node, floor(epoch(ts) / 3600)::bigint + 1 + unnest(range(6)) AS step, value FROM events),
h AS (SELECT node, step, {", ".join(f"count_if(value <= {b}) AS c{k}" for k, b in enumerate(_BOUNDS))}, count(*) AS n FROM x GROUP BY ALL),
o AS (SELECT node, step, round(CASE {_INSIDE} ELSE {float(_BOUNDS[-1])}::double END, 6) AS v FROM h),
s AS (SELECT *, step - row_number() OVER (PARTITION BY node ORDER BY step) AS spell FROM o WHERE v > 180)
SELECT node, make_timestamp(min(step) * 3600000000) AS starts, make_timestamp((min(step) + 4) * 3600000000) AS fires_at, make_timestamp(max(step) * 3600000000) AS ends, max(v) AS peak FROM s GROUP BY node, spell HAVING max(step) - min(step) >= 4"""
)
def latency_p95_alerts(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").withColumnRenamed("event_type", "node")
    found = evaluation.quantile_alerts(rows, "value", "ts", ["node"], 0.95, 180.0, step_s=3600, range_s=6 * 3600, for_s=4 * 3600)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "fires_at", "ends")})


@query(
    _BM25
    + """, top5 AS (SELECT query_id, chunk_id AS doc_id FROM bm25_top WHERE rank < 5), asp AS (SELECT query_id, source, bool_or(t.doc_id IS NOT NULL) AS hit
  FROM labels l JOIN documents d USING (doc_id) LEFT JOIN top5 t USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, round(avg(hit::int), 6) AS coverage FROM asp GROUP BY ALL"""
)
def coverage_at_k(spark, sf_dir):
    """An aspect of a query is a source that holds a relevant document."""
    held = counted(spark, sf_dir)
    ranked = _bm25_top(spark, sf_dir, held).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    sources = catalog.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("aspect"))
    return evaluation.coverage_at_k(ranked, relevance(spark, sf_dir, held).join(sources, "doc_id"), 5)


#: Strings that no answer may hold.
_FORBIDDEN = ("password=", "AKIA", 'token = "')
_FACTS = base.content("query_text", text.LEXICAL, text.RERANK_STOP, 6)


def answer_samples(spark, sf_dir):
    """Answers with what they are judged by: their claims and citations, the documents that hold the item, its longer words
    as facts. A query without a relevant document should be abstained from."""
    counts = counted(spark, sf_dir)
    pool = reranked(spark, sf_dir, counts)
    groups = pool.select("query_id", F.concat(F.lit("E"), F.col("final_rank") + 1).alias("marker"), "chunk_id", "text")
    said = grounding.extractive_answers(catalog.queries(spark, sf_dir).select("query_id", "query_text"), groups.select("query_id", "marker", "text"))
    said = said.withColumn("abstained", F.col("answer").isin(grounding.NO_ANSWER, grounding.NO_EVIDENCE))
    claimed = grounding.claims(said).groupBy("query_id").agg(F.count(F.lit(1)).alias("claims_total"), F.count_if(F.size("markers") > 0).alias("claims_cited"))
    cited = said.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(grounding.MARKER), F.lit(1)))).alias("marker"))
    cited = cited.join(groups.select("query_id", "marker", "chunk_id"), ["query_id", "marker"]).groupBy("query_id").agg(F.collect_list("chunk_id").alias("citations"))
    # only whether a cited document is relevant matters, so a query's relevant documents are few or those that it cites
    known = relevance(spark, sf_dir, counts)
    held = known.join(pool.select("query_id", F.col("chunk_id").alias("doc_id"), F.lit(True).alias("pooled")), ["query_id", "doc_id"], "left")
    held = held.groupBy("query_id").agg(F.concat(F.collect_list(F.when(F.col("pooled"), F.col("doc_id"))), F.array(F.min("doc_id"))).alias("relevant"))
    asked = catalog.queries(spark, sf_dir).select("query_id", text.content(F.col("query_text"), text.LEXICAL, text.RERANK_STOP, 6).alias("expected_facts"))
    rows = said.join(claimed, "query_id", "left").join(cited, "query_id", "left").join(held, "query_id", "left").join(asked, "query_id")
    none = F.col("relevant").isNull()
    return rows.withColumns({
        "expect_abstain": none,
        "expected_outcome": F.when(none, "abstained"),
        "outcome": F.when(F.col("abstained"), "abstained").otherwise("answered"),
        "forbidden": F.array(*[F.lit(x) for x in _FORBIDDEN]),
    })


@query(
    _ANSWER
    + f""", sm AS (SELECT a.query_id, answer, answer IN ('The retrieved evidence does not address that question.', 'I do not have evidence in context to answer that.') AS gone, {_FACTS} AS facts,
  (SELECT count(*) FROM cl WHERE cl.query_id = a.query_id) AS n_claims, (SELECT count(*) FROM cl WHERE cl.query_id = a.query_id AND len(markers) > 0) AS n_cited,
  (SELECT count(*) FROM labels l WHERE l.query_id = a.query_id) AS n_rel FROM ans a JOIN queries USING (query_id)),
mk AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(E\\d+)\\]', 1)) AS marker FROM ans), ci AS (SELECT m.query_id, count(*) AS n, count(l.doc_id) AS good
  FROM mk m JOIN final f ON f.query_id = m.query_id AND 'E' || (f.final_rank + 1) = m.marker LEFT JOIN labels l ON l.query_id = f.query_id AND l.doc_id = f.chunk_id GROUP BY ALL),
sc5 AS (SELECT s.query_id, unnest([
  {{'m': 'groundedness', 's': CASE WHEN NOT gone AND n_claims > 0 THEN n_cited::double / n_claims END, 't': 0.9::double}},
  {{'m': 'citation_precision', 's': CASE WHEN NOT gone AND n_rel > 0 THEN coalesce(good::double / n, 0) END, 't': 0.95::double}},
  {{'m': 'completeness', 's': CASE WHEN len(facts) > 0 THEN len(list_filter(facts, lambda f: contains(lower(answer), lower(f))))::double / len(facts) END, 't': 1.0::double}},
  {{'m': 'abstention_correct', 's': (gone = (n_rel = 0))::int::double, 't': 1.0::double}},
  {{'m': 'adversarial', 's': ((n_rel > 0 OR gone) AND NOT list_bool_or(list_transform({base.listed(_FORBIDDEN)}, lambda f: contains(answer, f))))::int::double, 't': 1.0::double}}]) AS x FROM sm s LEFT JOIN ci USING (query_id))
SELECT query_id, x.m AS metric_id, round(x.s, 6) AS score, round(x.s, 6) >= x.t AS passed FROM sc5"""
)
def answer_quality(spark, sf_dir):
    return evaluation.answer_scores(answer_samples(spark, sf_dir))
