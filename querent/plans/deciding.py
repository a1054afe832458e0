"""Queries over conflicts, confidence, calibration and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import evaluation, fusion
from querent.sources import catalog
from querent.sources.shared import cut

from . import base
from .base import query
from .evidence import _ROOTS, with_roots
from .retrieval import _BM25, reranked

_NUM = "regexp_matches(w, '^\\d+(\\.\\d+)?$')"


def _stance_sql(c):
    words = f"list_transform({base.toks(c, text.STANCE)}, lambda w: regexp_replace(w, '\\.+$', ''))"
    off = base.listed([*text.STANCE_STOP, *text.NEGATIONS])
    return f"""{{'words': list_distinct(list_filter({words}, lambda w: NOT {_NUM} AND NOT list_contains({off}, w))), 'numbers': list_distinct(list_filter({words}, lambda w: {_NUM})),
    'negated': list_has_any({words}, {base.listed(text.NEGATIONS)})}}"""


_STANCE = f"""CASE WHEN len(a.words) > 0 AND ({base.covered("a.words", "b.words")}) >= 0.6::double THEN CASE WHEN (len(a.numbers) > 0 AND len(b.numbers) > 0 AND NOT list_has_all(b.numbers, a.numbers)) OR a.negated <> b.negated THEN 'contradicts' ELSE 'supports' END END"""


@query(
    f"""WITH t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' is 30 days' WHEN 1 THEN ' is not 45 days' ELSE '' END AS s FROM conversations), p AS (SELECT conv_id, turn, {_stance_sql("s")} AS p FROM t),
j AS (SELECT x.conv_id, x.turn AS left_turn, y.turn AS right_turn, x.p AS a, y.p AS b FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.turn < y.turn)
SELECT conv_id, left_turn, right_turn, {_STANCE} AS stance FROM j"""
)
def stance_pairs(spark, sf_dir):
    n = F.col("turn") % 3
    s = F.concat("text", F.when(n == 0, " is 30 days").when(n == 1, " is not 45 days").otherwise(""))
    rows = catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", fusion.stance_parts(s).alias("p"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    return pairs.select("a.conv_id", F.col("a.turn").alias("left_turn"), F.col("b.turn").alias("right_turn"), fusion.stance(F.col("a.p"), F.col("b.p")).alias("stance"))


_GROUPS = _BM25.replace("labels AS", f"{_ROOTS}, labels AS") + ", gr AS (SELECT query_id, final_rank AS place, lineage_root, authority, rerank_score, updated_at_ms, text FROM final JOIN docs ON doc_id = chunk_id JOIN roots ON roots.doc_id = chunk_id)"


def groups(spark, sf_dir):
    rows = with_roots(spark, sf_dir, reranked(spark, sf_dir))
    return cut(rows.select("query_id", F.col("final_rank").alias("place"), "lineage_root", "authority", "rerank_score", "updated_at_ms", "text"), "groups")


_SENTS = f"""sn AS (SELECT query_id, place, lineage_root, authority, list_filter(list_transform({base.sentences("text")}, lambda s: trim(s)), lambda s: length(s) > 12) AS ss FROM gr),
sx AS (SELECT query_id, place, lineage_root, authority, unnest(ss) AS s, generate_subscripts(ss, 1) AS n FROM sn), sp AS MATERIALIZED (SELECT *, {_stance_sql("s")} AS p FROM sx),
cp AS (SELECT x.query_id, x.place AS left_place, y.place AS right_place, x.lineage_root AS left_root, y.lineage_root AS right_root, x.s AS left_text, y.s AS right_text, x.n AS ln, y.n AS rn, x.authority AS xa, y.authority AS ya, x.p AS a, y.p AS b
  FROM sp x JOIN sp y ON x.query_id = y.query_id AND x.place < y.place AND x.lineage_root <> y.lineage_root),
cf AS (SELECT *, row_number() OVER (PARTITION BY query_id, least(left_root, right_root), greatest(left_root, right_root) ORDER BY left_place, right_place, ln, rn) AS k FROM cp WHERE {_STANCE} = 'contradicts' QUALIFY k = 1)"""


@query(f"{_GROUPS}, {_SENTS} SELECT query_id, left_place, right_place, left_root, right_root, left_text, right_text, CASE WHEN round(abs(xa - ya), 6) < 0.15 THEN 'surfaced' ELSE 'authority_wins' END AS resolution FROM cf")
def source_conflicts(spark, sf_dir):
    rows = fusion.source_conflicts(groups(spark, sf_dir))
    return rows.withColumn("left_place", F.col("left_place").cast("long")).withColumn("right_place", F.col("right_place").cast("long"))


_CONFIDENCE = """tp AS (SELECT query_id, least(1.0, greatest(0.0, max(rerank_score))) AS top FROM gr GROUP BY 1),
rc AS (SELECT query_id, CASE WHEN top IS NULL THEN 0.5::double ELSE round(0.8::double * top + 0.2::double * least(1.0, count(DISTINCT CASE WHEN coalesce(rerank_score, 0) >= greatest(top * 0.5::double, 0.4::double) THEN lineage_root END)::double / 2), 6) END AS confidence FROM gr JOIN tp USING (query_id) GROUP BY query_id, top)"""


@query(f"{_GROUPS}, {_CONFIDENCE} SELECT query_id, confidence FROM rc")
def retrieval_confidence(spark, sf_dir):
    return fusion.retrieval_confidence(groups(spark, sf_dir))


_AGREEMENT = """dp AS (SELECT DISTINCT query_id, lineage_root FROM gr WHERE lineage_root % 4 = 1), rt AS (SELECT query_id, lineage_root, max(authority) AS authority FROM gr GROUP BY ALL),
ag AS (SELECT r.query_id, CASE WHEN sum(authority) > 0 THEN round(sum(CASE WHEN d.query_id IS NULL THEN authority ELSE 0 END) / sum(authority), 6) ELSE 0 END AS agreement FROM rt r LEFT JOIN dp d ON r.query_id = d.query_id AND r.lineage_root = d.lineage_root GROUP BY 1)"""


@query(f"{_GROUPS}, {_AGREEMENT} SELECT * FROM ag")
def independent_agreement(spark, sf_dir):
    rows = groups(spark, sf_dir)
    return fusion.independent_agreement(rows, rows.where("lineage_root % 4 = 1"))


@query(f"{_GROUPS}, ol AS (SELECT query_id, min(updated_at_ms) AS oldest_ms FROM gr WHERE updated_at_ms > 0 GROUP BY 1) SELECT *, round((1704067200000 - oldest_ms) / (180.0::double * 86400000), 6) AS ratio FROM ol WHERE round((1704067200000 - oldest_ms) / (180.0::double * 86400000), 6) > 1")
def staleness(spark, sf_dir):
    return fusion.staleness(groups(spark, sf_dir), F.lit(180.0))


@query(
    f"""{_GROUPS}, {_SENTS}, {_CONFIDENCE}, {_AGREEMENT}, nc AS (SELECT query_id, count(*) AS n_conflicts, bool_or(round(abs(xa - ya), 6) < 0.15) AS surfaced FROM cf GROUP BY 1),
ol AS (SELECT query_id, round((1704067200000 - min(updated_at_ms)) / (180.0::double * 86400000), 6) > 1 AS stale FROM gr WHERE updated_at_ms > 0 GROUP BY 1),
x AS (SELECT query_id, confidence AS p_ret, CASE query_id % 4 WHEN 0 THEN 0.9::double WHEN 1 THEN 0.5::double WHEN 2 THEN 0.2::double END AS p_par, agreement, (SELECT max(authority) FROM gr WHERE gr.query_id = rc.query_id) AS am,
  coalesce(surfaced, false) AS surfaced, coalesce(n_conflicts, 0) AS n_conflicts, query_id % 6 = 1 AS pc, coalesce(stale, false) AS stale, query_id % 2 = 0 AS private, query_id % 3 = 0 AS ambiguous, query_id % 2 = 1 AS strict
  FROM rc JOIN ag USING (query_id) LEFT JOIN nc USING (query_id) LEFT JOIN ol USING (query_id)),
y AS (SELECT *, CASE WHEN private AND p_ret < 0.4 THEN 'private_query_no_evidence' WHEN p_ret < 0.4 AND coalesce(p_par, 0) < 0.7 AND ambiguous THEN 'ambiguous_needs_clarification' WHEN p_ret < 0.4 AND coalesce(p_par, 0) < 0.7 THEN 'knowledge_below_floor' WHEN stale AND strict THEN 'evidence_too_stale' END AS reason_code FROM x)
SELECT query_id, CASE WHEN reason_code IS NOT NULL THEN 'abstain' WHEN p_ret < 0.4 THEN 'parametric' ELSE 'retrieved_evidence' END AS basis, reason_code,
  round(0.4::double * p_ret * am * 0.5::double + 0.2::double * coalesce(p_par, 0) * 0.55::double + 0.2::double * agreement - 0.15::double * CASE WHEN surfaced THEN 1.0 WHEN n_conflicts > 0 THEN 0.5 ELSE 0 END::double - 0.05::double * 0
  + CASE WHEN reason_code IS NULL AND p_ret >= 0.4 AND coalesce(p_par, 0) >= 0.4 AND NOT pc AND p_ret < 0.7 THEN 0.1::double ELSE 0 END, 4) AS knowledge_score FROM y"""
)
def decision_table(spark, sf_dir):
    rows = groups(spark, sf_dir)
    q = F.col("query_id")
    made = fusion.retrieval_confidence(rows).join(fusion.independent_agreement(rows, rows.where("lineage_root % 4 = 1")), "query_id").join(rows.groupBy("query_id").agg(F.max("authority").alias("authority_max")), "query_id")
    conflicts = fusion.source_conflicts(rows).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_conflicts"), F.bool_or(F.col("resolution") == "surfaced").alias("surfaced"))
    stale = fusion.staleness(rows, F.lit(180.0)).select("query_id", F.lit(True).alias("stale"))
    made = made.join(conflicts, "query_id", "left").join(stale, "query_id", "left").na.fill({"n_conflicts": 0, "surfaced": False, "stale": False})
    made = made.select(
        "query_id", F.col("confidence").alias("p_ret"), F.when(q % 4 == 0, 0.9).when(q % 4 == 1, 0.5).when(q % 4 == 2, 0.2).alias("p_par"), "agreement", "authority_max", F.lit(0.5).alias("freshness"),
        "surfaced", "n_conflicts", (q % 6 == 1).alias("parametric_conflict"), "stale", (q % 2 == 0).alias("private"), (q % 3 == 0).alias("ambiguous"), (q % 2 == 1).alias("strict"), F.lit(0.0).alias("coverage_gap"),
    )
    return fusion.decided(made).select("query_id", "basis", "reason_code", "knowledge_score")


_SCORED = "s AS (SELECT doc_id, source, quality, round(least(1.0, n_chars / 6000.0), 4)::double AS p FROM labels JOIN documents USING (doc_id))"


def scored_labels(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents").select("doc_id", "source", F.round(F.least(F.lit(1.0), F.col("n_chars") / 6000.0), 4).alias("p"))
    return catalog.table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "source", "quality", "p")


@query(f"WITH {_SCORED} SELECT least(9, floor(p * 10))::bigint AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS hit_rate FROM s GROUP BY 1")
def ece_bins(spark, sf_dir):
    return evaluation.ece_bins(scored_labels(spark, sf_dir), "p", "quality")


@query()
def isotonic_knots(spark, sf_dir):
    """Pool-adjacent-violators is iterative; tests hold the brute force."""
    return fusion.isotonic_fit(scored_labels(spark, sf_dir), "source", "p", "quality")


@query(
    f"""WITH {_SCORED}, k(x, y) AS (VALUES (0.1::double, 0.2::double), (0.4::double, 0.5::double), (0.8::double, 0.9::double)),
a AS (SELECT doc_id, p, (SELECT max(x) FROM k WHERE x <= p) AS lo, (SELECT min(x) FROM k WHERE x > p) AS hi FROM s)
SELECT doc_id, round(CASE WHEN lo IS NULL THEN 0.2 WHEN hi IS NULL THEN 0.9 ELSE (SELECT y FROM k WHERE x = lo) + ((SELECT y FROM k WHERE x = hi) - (SELECT y FROM k WHERE x = lo)) * (p - lo) / (hi - lo) END, 6) AS calibrated FROM a"""
)
def isotonic_apply(spark, sf_dir):
    rows = scored_labels(spark, sf_dir).withColumn("model", F.lit("m"))
    knots = rows.select("model").distinct().select("model", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.2), (0.4, 0.5), (0.8, 0.9))])).alias("k")).select("model", "k.*")
    return fusion.isotonic_apply(rows, knots, "model", "p").select("doc_id", "calibrated")


@query(
    """WITH a AS (SELECT event_id, user_id % 20 AS adapter, ts, (event_type = 'error')::int AS c FROM events),
w AS (SELECT *, count(*) OVER l AS n, round(avg(c) OVER l, 6) AS rate FROM a WINDOW l AS (PARTITION BY adapter ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, max((n >= 20 AND rate > 0.2)::int) OVER (PARTITION BY adapter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS demoted FROM w)
SELECT event_id, adapter, n, rate, CASE WHEN demoted THEN 'demote' WHEN n >= 20 AND rate > 0.05 THEN 'retrain' ELSE 'keep' END AS action FROM d"""
)
def drift_monitor(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 20).alias("adapter"))
    return fusion.monitored(rows, "adapter", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "adapter", "n", "rate", "action")


@query("SELECT event_id, CASE WHEN v IS NULL AND lp IS NULL THEN NULL ELSE greatest(0.0, least(1.0, (coalesce(v, 0) + coalesce(exp(lp), 0)) / ((v IS NOT NULL)::int + (lp IS NOT NULL)::int))) END::decimal(9,6)::double AS score FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value / 100 END AS v, CASE WHEN event_id % 2 = 0 THEN -(event_id % 7) / 10.0::double END AS lp FROM events)")
def raw_parametric_score(spark, sf_dir):
    n = F.col("event_id")
    score = fusion.raw_parametric_score(F.when(n % 3 > 0, F.col("value") / 100), F.exp(F.when(n % 2 == 0, -(n % 7) / F.lit(10.0))))
    return catalog.table(spark, sf_dir, "events").select("event_id", score.cast("decimal(9,6)").cast("double").alias("score"))
