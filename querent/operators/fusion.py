"""Conflicts between sources, retrieval confidence, agreement, staleness, calibration and the decision table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.sources.catalog import CLOCK_MS, DAY_MS
from querent.sources.shared import cut

TOPICAL, SURFACE_BELOW, CORROBORATION_FLOOR, DEGRADED_CONFIDENCE = 0.6, 0.15, 0.4, 0.5
HIGH, MODERATE, PARAMETRIC_AUTHORITY = 0.7, 0.4, 0.55
#: Weights of evidence, parametric confidence, agreement, conflict penalty and coverage gap.
WEIGHTS = (0.4, 0.2, 0.2, 0.15, 0.05)
MONITOR_WINDOW, MONITOR_LEAST, DEMOTE_ABOVE, RETRAIN_ABOVE = 200, 20, 0.20, 0.05


def stance_parts(body: Column) -> Column:
    """Content words, numbers and whether a text is negated, as a struct."""
    words = F.transform(text.tokens(body, text.STANCE), lambda w: F.regexp_replace(w, r"\.+$", ""))
    number = lambda w: w.rlike(r"^\d+(\.\d+)?$")
    off = F.array(*[F.lit(w) for w in [*text.STANCE_STOP, *text.NEGATIONS]])
    nos = F.array(*[F.lit(w) for w in text.NEGATIONS])
    return F.struct(
        F.array_distinct(F.filter(words, lambda w: ~number(w) & ~F.array_contains(off, w))).alias("words"),
        F.array_distinct(F.filter(words, number)).alias("numbers"),
        F.arrays_overlap(words, nos).alias("negated"),
    )


def stance(claim: Column, evidence: Column) -> Column:
    """`supports`, `contradicts`, or null where the evidence is about something else; both sides are stance_parts()."""
    topical = text.covered(claim["words"], evidence["words"]) >= TOPICAL
    odd = (F.size(claim["numbers"]) > 0) & (F.size(evidence["numbers"]) > 0) & (F.size(F.array_except(claim["numbers"], evidence["numbers"])) > 0)
    return F.when(topical & (F.size(claim["words"]) > 0), F.when(odd | (claim["negated"] != evidence["negated"]), "contradicts").otherwise("supports"))


def source_conflicts(groups: DataFrame) -> DataFrame:
    """The first contradiction of each pair of lineages in a query's groups (query_id, place, lineage_root, authority, text)."""
    parts = F.filter(F.transform(text.sentences(F.col("text")), lambda s: F.trim(s)), lambda s: F.length(s) > 12)
    rows = groups.select("query_id", "place", "lineage_root", "authority", F.posexplode(parts).alias("n", "s")).withColumn("p", stance_parts(F.col("s")))
    rows = cut(rows, "sentences")  # read four times below
    # sentences on one topic share a word among the rarest of the first, so only such pairs are made
    key = ["query_id", "place", "n"]
    words = rows.select(*key, F.size("p.words").alias("size"), F.explode("p.words").alias("word"))
    seen = words.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("df", "word"))
    first = words.join(seen, ["query_id", "word"]).withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * TOPICAL - 1e-9) + 1)
    x, y = first.alias("x"), words.alias("y")
    met = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.word") == F.col("y.word")) & (F.col("x.place") < F.col("y.place")))
    met = met.select("x.query_id", F.col("x.place").alias("xp"), F.col("x.n").alias("xn"), F.col("y.place").alias("yp"), F.col("y.n").alias("yn")).distinct().alias("m")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = met.join(a, (F.col("m.query_id") == F.col("a.query_id")) & (F.col("m.xp") == F.col("a.place")) & (F.col("m.xn") == F.col("a.n")))
    pairs = pairs.join(b, (F.col("m.query_id") == F.col("b.query_id")) & (F.col("m.yp") == F.col("b.place")) & (F.col("m.yn") == F.col("b.n")) & (F.col("a.lineage_root") != F.col("b.lineage_root")))
    pairs = pairs.where(stance(F.col("a.p"), F.col("b.p")) == "contradicts")
    gap = F.abs(F.col("a.authority") - F.col("b.authority"))
    rows = pairs.select(F.col("a.query_id").alias("query_id"), F.col("a.place").alias("left_place"), F.col("b.place").alias("right_place"), F.col("a.lineage_root").alias("left_root"), F.col("b.lineage_root").alias("right_root"), F.col("a.s").alias("left_text"), F.col("b.s").alias("right_text"), F.col("a.n").alias("ln"), F.col("b.n").alias("rn"), F.when(F.round(gap, 6) < SURFACE_BELOW, "surfaced").otherwise("authority_wins").alias("resolution"))
    first = F.row_number().over(Window.partitionBy("query_id", F.least("left_root", "right_root"), F.greatest("left_root", "right_root")).orderBy("left_place", "right_place", "ln", "rn"))
    return rows.withColumn("k", first).where("k = 1").drop("k", "ln", "rn")


def retrieval_confidence(groups: DataFrame) -> DataFrame:
    """The best rerank score and its corroboration by other lineages, for each query with groups (query_id, lineage_root,
    rerank_score)."""
    top = groups.groupBy("query_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("rerank_score"))).alias("top"))
    rows = groups.join(top, "query_id")
    agrees = F.coalesce("rerank_score", F.lit(0.0)) >= F.greatest(F.col("top") * 0.5, F.lit(CORROBORATION_FLOOR))
    roots = F.count_distinct(F.when(agrees, F.col("lineage_root")))
    return rows.groupBy("query_id", "top").agg(roots.alias("roots")).select("query_id", F.when(F.col("top").isNull(), F.lit(DEGRADED_CONFIDENCE)).otherwise(F.round(0.8 * F.col("top") + 0.2 * F.least(F.lit(1.0), F.col("roots") / 2), 6)).alias("confidence"))


def independent_agreement(groups: DataFrame, disputed: DataFrame) -> DataFrame:
    """Authority-weighted share of undisputed lineages; a lineage counts once, at its greatest authority."""
    roots = groups.groupBy("query_id", "lineage_root").agg(F.max("authority").alias("authority"))
    rows = roots.join(disputed.select("query_id", "lineage_root").distinct().withColumn("odd", F.lit(True)), ["query_id", "lineage_root"], "left")
    total = F.sum("authority")
    return rows.groupBy("query_id").agg(F.when(total > 0, F.round(F.sum(F.when(F.col("odd").isNull(), F.col("authority")).otherwise(0.0)) / total, 6)).otherwise(0.0).alias("agreement"))


def staleness(groups: DataFrame, half_life_days: Column) -> DataFrame:
    """Age of the oldest dated group against the half-life, where it is over 1; undated groups (0) don't count."""
    oldest = groups.where("updated_at_ms > 0").groupBy("query_id").agg(F.min("updated_at_ms").alias("oldest_ms"))
    ratio = F.round((F.lit(CLOCK_MS) - F.col("oldest_ms")) / (half_life_days * DAY_MS), 6)
    return oldest.withColumn("ratio", ratio).where("ratio > 1")


def decided(rows: DataFrame) -> DataFrame:
    """The decision table over rows with p_ret, p_par (null: no parametric signal), agreement, authority_max, freshness,
    surfaced, n_conflicts, parametric_conflict, stale, private, ambiguous, strict and coverage_gap."""
    w1, w2, w3, w4, w5 = WEIGHTS
    par = F.coalesce("p_par", F.lit(0.0))
    penalty = F.when(F.col("surfaced"), 1.0).when(F.col("n_conflicts") > 0, 0.5).otherwise(0.0)
    score = w1 * F.col("p_ret") * F.col("authority_max") * F.col("freshness") + w2 * par * PARAMETRIC_AUTHORITY + w3 * F.col("agreement") - w4 * penalty - w5 * F.col("coverage_gap")
    low = F.col("p_ret") < MODERATE
    code = (
        F.when(F.col("private") & low, "private_query_no_evidence")
        .when(low & (par < HIGH) & F.col("ambiguous"), "ambiguous_needs_clarification")
        .when(low & (par < HIGH), "knowledge_below_floor")
        .when(F.col("stale") & F.col("strict"), "evidence_too_stale")
    )
    boosted = code.isNull() & ~low & F.col("p_par").isNotNull() & (par >= MODERATE) & ~F.col("parametric_conflict") & (F.col("p_ret") < HIGH)
    basis = F.when(code.isNotNull(), "abstain").when(low, "parametric").otherwise("retrieved_evidence")
    return rows.withColumn("basis", basis).withColumn("reason_code", code).withColumn("knowledge_score", F.round(score + F.when(boosted, 0.1).otherwise(0.0), 4))


def raw_parametric_score(*signals: Column) -> Column:
    """Mean of the signals that are there, within 0 and 1; null without any."""
    there = F.array_compact(F.array(*signals))
    return F.when(F.size(there) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))))


def isotonic_fit(samples: DataFrame, by: str, score: str, outcome: str) -> DataFrame:
    """Knots (mean score and mean outcome of each pooled block) of the monotone fit of each group.

    Equal scores are pooled before anything else, by an ordinary aggregation with map-side sums, and the pooled scores are
    on a grid of four decimals; so a group that reaches a task has at most 10001 rows, however many samples it has."""
    pooled = samples.groupBy(by, F.round(score, 4).alias("x")).agg(F.sum(F.col(outcome).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for x, s, n in rows.sort_values("x")[["x", "s", "n"]].itertuples(index=False):
            blocks.append([x * n, s, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] > blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        return pd.DataFrame({by: rows[by].iloc[0], "k": range(len(blocks)), "x": [round(b[0] / b[2], 6) for b in blocks], "y": [round(b[1] / b[2], 6) for b in blocks]})

    kind = samples.schema[by].dataType.simpleString()
    return pooled.groupBy(by).applyInPandas(fit, f"{by} {kind}, k int, x double, y double")


def isotonic_apply(rows: DataFrame, knots: DataFrame, by: str, score: str) -> DataFrame:
    """Piecewise-linear value of the fit, flat at both ends. Knots of a group are one sorted array."""
    lists = knots.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots"))
    p, k = F.col(score), F.col("knots")
    upto = F.size(F.filter(k, lambda q: q["x"] <= p))
    a, b = F.get(k, upto - 1), F.get(k, upto)
    between = F.when(upto == 0, F.get(k, F.lit(0))["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (p - a["x"]) / (b["x"] - a["x"]))
    return rows.join(lists, by, "left").withColumn("calibrated", F.round(between, 6)).drop("knots")


def monitored(attempts: DataFrame, by: str, order: list[str], conflicted: Column) -> DataFrame:
    """Conflict rate over the last attempts of each adapter; demotion sticks once it is reached."""
    last = Window.partitionBy(by).orderBy(*order).rowsBetween(-(MONITOR_WINDOW - 1), 0)
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("n", F.count(F.lit(1)).over(last)).withColumn("rate", F.round(F.avg(conflicted.cast("double")).over(last), 6))
    rows = rows.withColumn("demoted", F.max((F.col("n") >= MONITOR_LEAST) & (F.col("rate") > DEMOTE_ABOVE)).over(so_far))
    action = F.when(F.col("demoted"), "demote").when((F.col("n") >= MONITOR_LEAST) & (F.col("rate") > RETRAIN_ABOVE), "retrain").otherwise("keep")
    return rows.withColumn("action", action)
