"""The parametric tier: clusters, question pairs, training stand-ins, probes, gates, selection and revocation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from querent.functions import text
from querent.sources.shared import cut

COVERAGE_FLOOR, MOST_ADAPTERS = 0.62, 3
#: The blockers, in order.
BLOCKERS = (
    "knowledge_class_not_parameterizable",
    "acl_narrower_than_tenant",
    "revocation_sla_shorter_than_retrain_cadence",
    "requires_exact_quotation",
    "half_life_below_floor",
    "per_claim_provenance_without_shadowing",
    "contested",
    "contains_pii",
)


def words(body: Column) -> Column:
    return text.with_stems(text.content(body, text.PLAIN, text.PARAMETRIC_STOP, 3))


def leader_clusters(passages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Clusters of each domain's passages (domain, passage_id, vector) in order of id: a passage joins the closest running
    mean at or over the threshold, or starts a cluster. A running mean depends on all passages before it, so a domain is
    one task's; domains are what spreads the work. mean_clusters() is the form for domains of any size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("passage_id")
        means, sizes, label, sims = [], [], [], []
        for v in map(np.asarray, rows["vector"]):
            norm = np.linalg.norm(v)
            best, at = -2.0, -1
            if means:
                m = np.array(means)
                lengths = np.linalg.norm(m, axis=1) * norm
                cos = np.divide(m @ v, lengths, out=np.zeros(len(m)), where=lengths > 0)
                at = int(np.argmax(np.round(cos, 12)))
                best = cos[at]
            if best >= threshold:
                sizes[at] += 1
                means[at] = means[at] + (v - means[at]) / sizes[at]
            else:
                at = len(means)
                means.append(v.astype(float))
                sizes.append(1)
            label.append(at)
        for at, v in zip(label, map(np.asarray, rows["vector"]), strict=True):
            lengths = np.linalg.norm(means[at]) * np.linalg.norm(v)
            sims.append(float(means[at] @ v / lengths) if lengths else 0.0)
        out = pd.DataFrame({"domain": rows["domain"], "passage_id": rows["passage_id"], "cluster": label, "sim": sims})
        out["coherence"] = out.groupby("cluster")["sim"].transform("mean").clip(upper=1).round(6)
        return out[["domain", "passage_id", "cluster", "coherence"]]

    kind = passages.schema["domain"].dataType.simpleString()
    return passages.groupBy("domain").applyInPandas(run, f"domain {kind}, passage_id long, cluster int, coherence double")


def mean_clusters(passages: DataFrame, centres: int = 16, rounds: int = 3, threshold: float = 0.5) -> DataFrame:
    """Clusters of each domain's passages (domain, passage_id, vector) around `centres` means at most, in a fixed number of
    rounds: every passage goes to the closest mean, then the means are taken anew. It doesn't depend on the order of rows,
    and a domain is spread over all tasks: only sums of a (domain, cluster, place) and the means themselves are grouped.

    Rows: domain, passage_id, cluster, coherence (mean cosine of the cluster's passages to its mean). A passage under the
    threshold, or whose vector is null or zero, belongs to no cluster: both are null. Vectors of a domain have one length.
    First means: the passage of smallest id in each of `centres` hash buckets. Null domains are one domain. Repeated rows
    count each; an empty table gives no rows."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(length > 0, F.transform("vector", lambda x: x / length))
    rows = cut(passages.select("domain", "passage_id", unit.alias("unit")), "units")
    bucket = F.pmod(F.xxhash64("passage_id"), F.lit(centres)).cast("int")
    first = rows.where("unit is not null").groupBy("domain", bucket.alias("cluster"))
    means = first.agg(F.min_by("unit", F.struct("passage_id", "unit")).alias("mean"))
    for _ in range(rounds):
        sums = _placed(rows, means).where("cluster is not null").select("domain", "cluster", F.posexplode("unit").alias("place", "x"))
        sums = sums.groupBy("domain", "cluster", "place").agg(F.round(F.avg("x"), 12).alias("x"))
        means = sums.groupBy("domain", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean"))
    placed = cut(_placed(rows, means).withColumn("cluster", F.when(F.col("sim") >= threshold, F.col("cluster"))), "placed")
    coherence = placed.where("cluster is not null").groupBy("domain", "cluster").agg(F.round(F.least(F.lit(1.0), F.avg("sim")), 6).alias("coherence")).alias("c")
    found = placed.alias("p").join(coherence, F.col("p.domain").eqNullSafe(F.col("c.domain")) & (F.col("p.cluster") == F.col("c.cluster")), "left")
    return found.select("p.domain", "p.passage_id", "p.cluster", "c.coherence")


@F.pandas_udf(StructType().add("cluster", IntegerType()).add("sim", DoubleType()))
def _closest(unit: pd.Series, means: pd.Series) -> pd.DataFrame:
    """Each row's closest mean of its domain, the first of equal ones."""
    place, sims = [], []
    for v, ms in zip(unit, means, strict=True):
        if v is None or ms is None:
            place.append(None)
            sims.append(None)
            continue
        m = np.stack(ms)
        lengths = np.linalg.norm(m, axis=1)
        cos = np.round(np.divide(m @ v, lengths, out=np.full(len(m), -2.0), where=lengths > 0), 9)
        at = int(np.argmax(cos))
        place.append(at)
        sims.append(float(cos[at]))
    return pd.DataFrame({"cluster": pd.array(place, dtype="Int32"), "sim": pd.array(sims, dtype="Float64")})


def _placed(rows: DataFrame, means: DataFrame) -> DataFrame:
    """Rows with their closest mean. The means of a domain are one stored row, of at most `centres` vectors; their table is
    broadcast where Spark finds its stored size under the session's limit, and joined by a shuffle (which AQE splits where
    a domain is hot) beyond it."""
    listed = means.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "mean"))), lambda s: s["mean"]).alias("means"))
    listed = cut(listed, "means").withColumnRenamed("domain", "_domain")
    near = rows.join(listed, F.col("domain").eqNullSafe(F.col("_domain")), "left").withColumn("near", _closest("unit", "means"))
    return near.select("domain", "passage_id", "unit", F.col("near.cluster").alias("cluster"), F.col("near.sim").alias("sim"))


def augmented(passages: DataFrame, by: str | None = None) -> DataFrame:
    """Three question surfaces for each sentence of a passage (document_id, text) with six content words or more. `by`: a
    further column that goes along."""
    own = [by] if by else []
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = passages.select(*own, "document_id", F.posexplode(text.sentences(clean)).alias("n", "answer"))
    found = F.regexp_extract_all("answer", F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0))
    stops = F.array(*[F.lit(w) for w in text.PARAMETRIC_STOP])
    rows = rows.withColumn("w", F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, F.lower(w)))).where(F.size("w") >= 6)
    n = F.size("w")
    surfaces = F.array(
        F.slice("w", F.lit(1), F.greatest(F.lit(3), F.floor(n * 2 / 3).cast("int"))),
        F.slice("w", F.floor(n / 3).cast("int") + 1, n),
        F.filter("w", lambda w, i: i % 2 == 0),
    )
    return rows.select(*own, "document_id", "n", "answer", F.posexplode(surfaces).alias("surface", "q")).select(*own, "document_id", "n", "surface", F.lower(F.array_join("q", " ")).alias("question"), "answer")


def filtered_pairs(pairs: DataFrame, sources: DataFrame, floor: float = 0.85, by: str | None = None) -> DataFrame:
    """Pairs with the reason for dropping them, if any: what the source doesn't entail, thin questions, and repeats. With
    `by`, sources and repeats are those of the same group."""
    own = [by] if by else []
    held = sources.select(*own, "document_id", words(F.col("text")).alias("held"))
    rows = pairs.join(held, [*own, "document_id"], "left").withColumn("asked", words(F.col("question"))).withColumn("said", words(F.col("answer")))
    share = text.covered(F.col("said"), F.coalesce("held", F.array().cast("array<string>")))
    why = F.when((F.size("said") == 0) | (share < floor), "not_entailed").when(F.size("asked") < 2, "low_diversity")
    rows = rows.withColumn("why", why).withColumn("key", F.array_join(F.array_sort("asked"), " "))
    first = F.row_number().over(Window.partitionBy(*own, F.col("why").isNull(), "key", "answer").orderBy("document_id", "n", "surface"))
    return rows.withColumn("reason", F.coalesce("why", F.when(first > 1, "duplicate"))).select(*own, "document_id", "n", "surface", "question", "answer", "reason")


def answered(questions: DataFrame, pairs: DataFrame, factor: float = 1.0) -> DataFrame:
    """Best stored answer of each question (adapter_id, question_id, question) among its adapter's pairs: by the share of
    asked words that a pair holds, then the greater answer. Pairs without a shared word score 0, so the join is by word."""
    asked = questions.select("adapter_id", "question_id", words(F.col("question")).alias("asked"))
    held = pairs.select("adapter_id", F.col("answer"), F.array_union(words(F.col("question")), words(F.col("answer"))).alias("held")).groupBy("adapter_id", "answer").agg(F.array_distinct(F.flatten(F.collect_set("held"))).alias("all"), F.collect_set("held").alias("helds"))
    terms = asked.select("adapter_id", "question_id", F.size("asked").alias("n"), F.explode("asked").alias("w"))
    stored = held.select("adapter_id", "answer", F.posexplode("helds").alias("k", "held")).select("adapter_id", "answer", "k", F.explode("held").alias("w"))
    hits = terms.join(stored, ["adapter_id", "w"]).groupBy("adapter_id", "question_id", "n", "answer", "k").agg(F.count(F.lit(1)).alias("both"))
    best = hits.groupBy("adapter_id", "question_id").agg(F.max(F.struct(F.round(factor * F.col("both") / F.col("n"), 6).alias("score"), "answer")).alias("b"))
    return questions.select("adapter_id", "question_id").join(best, ["adapter_id", "question_id"], "left").select("adapter_id", "question_id", F.coalesce("b.score", F.lit(0.0)).alias("score"), "b.answer")


def promotion_reasons(recall: Column, regression: Column, interference: Column, least=0.80, most_regression=0.02, most_interference=0.03) -> Column:
    return F.array_compact(F.array(F.when(recall < least, "knowledge_recall_below_floor"), F.when(regression > most_regression, "general_regression_above_tolerance"), F.when(interference > most_interference, "interference_above_tolerance")))


def eligibility(rows: DataFrame, min_half_life=90.0, cadence=168.0, least_queries=500.0, savings=0.6, coherence=0.55, shadowing=True) -> DataFrame:
    """All hard blockers in order; economic reasons only where there is none. Rows have the record's flags, training_usd,
    queries_per_period, usd_per_query (grounded) and coherence."""
    flags = (
        F.col("knowledge_class").isin("live", "personal", "regulated"),
        F.col("acl_narrower_than_tenant"),
        F.coalesce(F.col("revocation_sla_hours") < cadence, F.lit(False)),
        F.col("requires_exact_quotation"),
        F.col("half_life_days") < min_half_life,
        F.col("requires_per_claim_provenance") & F.lit(not shadowing),
        F.col("contested"),
        F.col("contains_pii"),
    )
    blocked = F.array_compact(F.array(*[F.when(c, F.lit(b)) for b, c in zip(BLOCKERS, flags, strict=True)]))
    amortised = F.when(F.col("queries_per_period") > 0, F.col("training_usd") / F.col("queries_per_period"))
    economic = F.array_compact(F.array(
        F.when(F.col("queries_per_period") < least_queries, "volume_below_floor"),
        F.when(~F.coalesce(amortised < F.col("usd_per_query") * savings, F.lit(False)), "savings_below_threshold"),
        F.when(F.col("coherence") < coherence, "cluster_incoherent"),
    ))
    out = rows.withColumn("blocking", blocked)
    out = out.withColumn("economic", F.when(F.size("blocking") > 0, F.array().cast("array<string>")).otherwise(economic))
    return out.withColumn("eligible", (F.size("blocking") == 0) & (F.size("economic") == 0)).withColumn("amortised_usd", F.when(F.size("blocking") == 0, F.round(amortised, 9)))


def selected_adapters(queries: DataFrame, adapters: DataFrame, floor: float = COVERAGE_FLOOR, most: int = MOST_ADAPTERS) -> DataFrame:
    """Adapters that may serve each query (query_id, tenant_id, base, embedding, vector), the best covered first. Adapters
    have adapter_id, tenant_id, base, embedding, status and centroid."""
    pairs = queries.join(adapters.where("status = 'promoted'"), ["tenant_id", "base", "embedding"])
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), text.cosine(F.col("vector"), F.col("centroid")))), 6)
    rows = pairs.select("query_id", "adapter_id", score.alias("coverage")).where(F.col("coverage") >= floor)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), "adapter_id")) - 1
    return rows.withColumn("place", place).where(F.col("place") < most)


def latest_status(transitions: DataFrame) -> DataFrame:
    """The last status of each adapter; a promotion deprecates what its slot had before."""
    last = transitions.groupBy("adapter_id").agg(F.max_by(F.struct("status", "slot"), "at_ms").alias("s"), F.max("at_ms").alias("at_ms")).select("adapter_id", "s.*", "at_ms")
    later = F.max(F.when(F.col("status") == "promoted", F.struct("at_ms", "adapter_id"))).over(Window.partitionBy("slot"))
    return last.withColumn("top", later).select("adapter_id", "slot", F.when((F.col("status") == "promoted") & (F.col("top.adapter_id") != F.col("adapter_id")), "deprecated").otherwise(F.col("status")).alias("status"))


def revoked(adapters: DataFrame, documents: DataFrame) -> DataFrame:
    """Adapters that learnt from any of the documents."""
    rows = adapters.select("adapter_id", F.explode("source_document_ids").alias("doc_id"))
    return rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("adapter_id").distinct()
