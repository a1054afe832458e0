"""Evaluation: retrieval metrics at k, answer metrics, scorecards, gates, histograms and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTOGRAM_BOUNDS = (25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


def first_occurrences(ranked: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Documents of each query by their first rank, ranked anew from 1."""
    first = ranked.groupBy("query_id", doc_col).agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", doc_col))).drop("first")


def ir_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Recall, precision, hit rate, reciprocal rank and NDCG at k for each labelled query; an unanswered query scores 0."""
    places = first_occurrences(ranked)
    relevant = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = places.join(labels.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    hits = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= k, F.coalesce("hit", F.lit(0)))).alias("found"),
        F.sum(F.when(F.col("place") <= k, 1)).alias("returned"),
        F.max(F.when(F.col("hit") == 1, 1 / F.col("place"))).alias("rr"),
        F.sum(F.when((F.col("place") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("place") + 1))).alias("dcg"),
    )
    rows = relevant.join(hits, "query_id", "left").na.fill(0, ["found", "returned"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        "query_id",
        F.round(F.col("found") / F.col("n_relevant"), 6).alias("recall"),
        F.when(F.col("returned") > 0, F.round(F.col("found") / F.col("returned"), 6)).otherwise(0.0).alias("precision"),
        (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def scorecard(samples: DataFrame) -> DataFrame:
    """Mean, count, pass rate over gated samples, and whether any was judged, for each metric; null scores are left out."""
    return samples.where("score is not null").groupBy("metric_id").agg(
        F.round(F.avg("score"), 6).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.max("judged").alias("judged"),
    )


def regression_gate(current: DataFrame, baseline: DataFrame, floors: DataFrame, calibrated: Column, tolerance: float = 0.02) -> DataFrame:
    """For each metric with a floor: why it fails, and whether it is gated at all."""
    rows = floors.join(current.select("metric_id", "mean", "judged"), "metric_id", "left").join(baseline.select("metric_id", F.col("mean").alias("before")), "metric_id", "left")
    ungated = F.coalesce("judged", F.lit(False)) & ~calibrated
    reasons = F.when(F.col("mean").isNull(), F.array(F.lit("missing"))).when(ungated, F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(F.when(F.col("mean") < F.col("floor"), "below_floor"), F.when(F.col("mean") < F.col("before") - tolerance, "regressed")))
    )
    return rows.select("metric_id", "floor", "mean", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"), (~ungated).alias("gated"))


def histogram(rows: DataFrame, value: str, by: list[str], bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative bucket counts, count and sum for each group; the last bucket holds everything."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds]
    return rows.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("le_inf"), F.round(F.sum(value), 2).alias("total"))


def alert_ratios(rows: DataFrame, flag: Column, ts: str, by: list[str], width: str, threshold: float) -> DataFrame:
    """Windows of time where the share of flagged rows is over the threshold."""
    grouped = rows.groupBy(*by, F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.round(F.avg(flag.cast("double")), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("ratio") > threshold).select(*by, F.col("w.start").alias("starts"), "ratio", "n")


#: Shape of a scorecard kept as text.
CARD = "dataset_id string, summaries map<string, struct<judged: boolean, mean: double, n: bigint, pass_rate: double>>"


def card_json(card: DataFrame, dataset_id: str) -> DataFrame:
    """One row, `json`: the summaries of a scorecard by metric, keys in order; a metric without a pass rate has none."""
    entry = F.struct("metric_id", F.struct("judged", "mean", F.col("n").cast("long").alias("n"), "pass_rate"))
    rows = card.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("summaries"))  # a row for each metric
    return rows.select(F.to_json(F.struct(F.lit(dataset_id).alias("dataset_id"), "summaries")).alias("json"))


def card_of_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """dataset_id and a row for each metric of scorecards kept as text; a text that is none fails the read."""
    card = rows.select(F.from_json(column, CARD, {"mode": "FAILFAST"}).alias("c")).select("c.dataset_id", F.explode("c.summaries").alias("metric_id", "s"))
    return card.select("dataset_id", "metric_id", "s.mean", "s.n", "s.pass_rate", "s.judged")


def bucket_quantile(q: float, counts: list[Column], total: Column, bounds) -> Column:
    """The q-quantile of a histogram of cumulative counts: linear within its bucket, the last bound above all of them."""
    rank, out, before, low = total * q, F.lit(float(bounds[-1])), F.lit(0), 0.0
    found = None
    for count, bound in zip(counts, bounds, strict=True):
        inside = F.lit(low) + (bound - low) * (rank - before) / F.nullif(count - before, F.lit(0))
        found = (F if found is None else found).when(count >= rank, F.coalesce(inside, F.lit(float(bound))))
        before, low = count, float(bound)
    return F.when(total > 0, found.otherwise(out))


def quantile_alerts(rows: DataFrame, value: str, ts: str, by: list[str], q: float, threshold: float, step_s: int, range_s: int, for_s: int, bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """Spells in which a quantile stays over a threshold for `for_s` seconds at least.

    At each multiple of step_s the quantile of the last range_s seconds is taken from a histogram, as a set of counters would
    give it: counts of each step are summed first and then added up by the evaluations that they enter (range_s / step_s
    of them), so no group of events is gathered. Evaluations over the threshold that follow each other are a spell; one
    without events ends it. Rows: by, starts (first evaluation over it), fires_at, ends (last one), peak. Events of null time
    or value are left out; a null group is a group."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    events = rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*by, F.ceil((at + 1) / step_s).alias("step"), F.col(value).alias("_v"))
    names = [f"le_{k}" for k in range(len(bounds))]
    steps = events.groupBy(*by, "step").agg(*[F.count_if(F.col("_v") <= b).alias(n) for n, b in zip(names, bounds, strict=True)], F.count(F.lit(1)).alias("total"))
    spread = steps.withColumn("step", F.explode(F.sequence(F.col("step"), F.col("step") + (range_s // step_s - 1))))
    found = spread.groupBy(*by, "step").agg(*[F.sum(n).alias(n) for n in names], F.sum("total").alias("total"))
    over = found.select(*by, "step", F.round(bucket_quantile(q, [F.col(n) for n in names], F.col("total"), bounds), 6).alias("value")).where(F.col("value") > threshold)
    # steps of a spell less their number among those over the threshold are one value
    spell = F.col("step") - F.row_number().over(Window.partitionBy(*by).orderBy("step"))
    spells = over.withColumn("_spell", spell).groupBy(*by, "_spell").agg(F.min("step").alias("a"), F.max("step").alias("b"), F.max("value").alias("peak"))
    long = spells.where((F.col("b") - F.col("a")) * step_s >= for_s)
    when = lambda c: F.timestamp_seconds(c)
    return long.select(*by, when(F.col("a") * step_s).alias("starts"), when(F.col("a") * step_s + for_s).alias("fires_at"), when(F.col("b") * step_s).alias("ends"), "peak")


def ece_bins(rows: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """Count, mean prediction and hit rate of each bin; the expected calibration error is their weighted gap."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(outcome).cast("double")), 6).alias("hit_rate"))


def coverage_at_k(ranked: DataFrame, aspects: DataFrame, k: int) -> DataFrame:
    """Share of each query's aspects (query_id, aspect, doc_id: a document that supports it) with a document in the top k."""
    top = first_occurrences(ranked).where(F.col("place") <= k).select("query_id", "doc_id", F.lit(True).alias("hit"))
    covered = aspects.join(top, ["query_id", "doc_id"], "left").groupBy("query_id", "aspect").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    return covered.groupBy("query_id").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("coverage"))


# The least score that passes, for each metric of an answer.
ANSWER_THRESHOLDS = {"groundedness": 0.9, "citation_precision": 0.95, "completeness": 1.0, "abstention_correct": 1.0, "adversarial": 1.0}


def answer_scores(samples: DataFrame) -> DataFrame:
    """query_id, metric_id, score and passed of each answer; a metric that a sample has no data for has null score and passed.

    Samples: query_id, answer, abstained, claims_total, claims_cited, citations and relevant (arrays of document ids),
    expected_facts, expect_abstain, expected_outcome, outcome, forbidden. Null and empty lists are missing data alike. A
    null answer holds nothing, and a sample of unknown abstention did not abstain. Citations that repeat count again.
    """
    answer, gone = F.coalesce("answer", F.lit("")), F.coalesce("abstained", F.lit(False))
    some = lambda c: F.coalesce(F.array_size(c), F.lit(0)) > 0
    right = F.size(F.filter("citations", lambda c: F.array_contains("relevant", c)))
    facts = F.size(F.filter("expected_facts", lambda f: F.contains(F.lower(answer), F.lower(f))))
    leaked = F.coalesce(F.exists("forbidden", lambda f: F.contains(answer, f)), F.lit(False))
    as_expected = F.col("expected_outcome").isNull() | F.coalesce(F.col("outcome") == F.col("expected_outcome"), F.lit(False))
    scores = {
        "groundedness": F.when(~gone & (F.col("claims_total") > 0), F.coalesce("claims_cited", F.lit(0)) / F.col("claims_total")),
        "citation_precision": F.when(~gone & some("relevant"), F.when(some("citations"), right / F.size("citations")).otherwise(0.0)),
        "completeness": F.when(some("expected_facts"), facts / F.size("expected_facts")),
        "abstention_correct": (gone == F.col("expect_abstain")).cast("double"),
        "adversarial": F.when(F.col("expected_outcome").isNotNull() | some("forbidden"), (as_expected & ~leaked).cast("double")),
    }
    made = [F.struct(F.lit(m).alias("metric_id"), F.round(s, 6).alias("score"), (F.round(s, 6) >= ANSWER_THRESHOLDS[m]).alias("passed")) for m, s in scores.items()]
    return samples.select("query_id", F.explode(F.array(*made)).alias("m")).select("query_id", "m.*")
