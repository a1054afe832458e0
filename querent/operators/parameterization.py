"""Clusters of knowledge turned into adapters: a staged run over all clusters at once.

The steps are scope, eligibility, augmentation, training, promotion_gate, registered and shadow. Each cluster goes on to its
first refusal; only what is left reaches the next step, so a refused cluster costs nothing after. The report has a row for
every cluster with the steps it took (the last one as `step:refused`), the reasons, what augmentation dropped, and its probes.

Training is the stand-in of this engine: the weights of a cluster are its sorted question pairs as JSON, one value, as a model's
bytes are. Surfaces 0 and 1 train, surface HELD_OUT probes. Recall is the share of held-out questions answered exactly;
regression is the share of general questions answered with a score of CONFIDENT or more; interference is what recall loses
when the pairs of siblings are there too.

Clusters: cluster_id (unique), domain, tenant_scope, tenant_id (of the knowledge), coherence, centroid and the columns that
parametric.eligibility() takes. Passages: cluster_id, document_id, text. A cluster without passages has nothing to train on.
Null texts make no pairs; repeated passages make duplicates, which are dropped and counted. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators import adapters, parametric
from querent.sources.shared import cut

HELD_OUT, CONFIDENT, MOST_NOT_ENTAILED = 2, 0.5, 0.2
REASONS = ("not_entailed", "low_diversity", "duplicate")


@dataclass(frozen=True)
class Gates:
    entailment: float = 0.85
    recall: float = 0.80
    regression: float = 0.02
    interference: float = 0.03


def scope_reason() -> Column:
    wide = (F.col("tenant_scope") == adapters.GLOBAL) & ~F.col("tenant_id").eqNullSafe(adapters.GLOBAL)
    other = ~F.col("tenant_scope").eqNullSafe(adapters.GLOBAL) & ~F.col("tenant_scope").eqNullSafe(F.col("tenant_id"))
    return F.when(wide, "tenant_knowledge_in_global_adapter").when(other, "adapter_scope_differs_from_knowledge_tenant")


def _judged(rows: DataFrame, step: str, reasons: Column, tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a step, and refused ones with the reasons (an array of strings)."""
    done = cut(rows.withColumn("reasons", reasons), tag)
    refused = done.where(F.size("reasons") > 0).withColumn("steps", F.array_append("steps", F.lit(f"{step}:refused")))
    return done.where(F.size("reasons") == 0).drop("reasons").withColumn("steps", F.array_append("steps", F.lit(step))), refused


def _one(reason: Column) -> Column:
    return F.array_compact(F.array(reason))


def recalls(held_out: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster_id and the share of held-out pairs whose question the pairs answer exactly."""
    asked = held_out.select(F.col("cluster_id").alias("adapter_id"), F.xxhash64("document_id", "n", "question", "answer").alias("question_id"), "question", "answer").distinct()
    got = parametric.answered(asked.drop("answer"), pairs.select(F.col("cluster_id").alias("adapter_id"), "question", "answer")).withColumnRenamed("answer", "said")
    hit = F.coalesce(F.col("said") == F.col("answer"), F.lit(False)).cast("double")
    return asked.join(got, ["adapter_id", "question_id"]).groupBy(F.col("adapter_id").alias("cluster_id")).agg(F.avg(hit).alias("recall"))


def regressions(clusters: DataFrame, pairs: DataFrame, probes: DataFrame) -> DataFrame:
    """cluster_id and the share of general questions (question) that its pairs answer confidently. Questions meet pairs by
    their words; only confident answers come out of that."""
    asked = probes.select("question").distinct().withColumn("question_id", F.xxhash64("question"))
    n = asked.count()
    every = clusters.select(F.col("cluster_id").alias("adapter_id")).crossJoin(F.broadcast(asked))  # a stated set of questions for each cluster
    got = parametric.answered(every, pairs.select(F.col("cluster_id").alias("adapter_id"), "question", "answer")).where(F.col("score") >= CONFIDENT)
    return got.groupBy(F.col("adapter_id").alias("cluster_id")).agg((F.count(F.lit(1)) / F.lit(n)).alias("regression"))


def parameterized(reg: adapters.Registry, clusters: DataFrame, passages: DataFrame, now_ms: int, probes: DataFrame | None = None, siblings: DataFrame | None = None, gates: Gates = Gates(), economics: dict | None = None) -> tuple[adapters.Registry, DataFrame]:
    """Runs the clusters through all steps; what passes is in the registry, in shadow. probes: question; siblings: cluster_id,
    question, answer of adapters that a cluster would be served with."""
    rows = clusters.withColumn("steps", F.array().cast("array<string>"))
    out = []

    rows, refused = _judged(rows, "scope", _one(scope_reason()), "scope")
    out.append(refused)
    rows, refused = _judged(parametric.eligibility(rows, **(economics or {})), "eligibility", F.when(~F.col("eligible"), F.concat("blocking", "economic")).otherwise(F.array().cast("array<string>")), "eligibility")
    out.append(refused)

    # augmentation, of the clusters that are left
    held = cut(passages.join(rows.select("cluster_id"), "cluster_id", "left_semi"), "passages")
    made = parametric.augmented(held, by="cluster_id")
    sources = held.groupBy("cluster_id", "document_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    judged = cut(parametric.filtered_pairs(made, sources, gates.entailment, by="cluster_id"), "pairs")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    left = F.col("reason").isNull()
    facts = judged.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("made"), *counts, F.count_if(left & (F.col("surface") != HELD_OUT)).alias("train"), F.count_if(left & (F.col("surface") == HELD_OUT)).alias("held_out"))
    rows = rows.join(facts, "cluster_id", "left").na.fill(0, ["made", *REASONS, "train", "held_out"])
    invented = F.when((F.col("made") > 0) & (F.col("not_entailed") / F.col("made") > MOST_NOT_ENTAILED), "augmenter_not_entailed_rate_too_high")
    rows, refused = _judged(rows, "augmentation", _one(invented), "augmentation")
    out.append(refused)
    # a refusal of the same name, after the step was noted
    empty = F.when((F.col("train") == 0) | (F.col("held_out") == 0), "nothing_to_train_on")
    before = F.slice("steps", F.lit(1), F.size("steps") - 1)  # without the step that the next call notes again
    again, refused = _judged(rows.withColumn("steps", before), "augmentation", _one(empty), "training")
    out.append(refused.withColumn("steps", F.concat(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array(F.lit("augmentation"), F.lit("augmentation:refused")))))

    kept = cut(judged.where("reason is null").join(again.select("cluster_id"), "cluster_id", "left_semi"), "kept")
    train, held_out = kept.where(F.col("surface") != HELD_OUT), kept.where(F.col("surface") == HELD_OUT)
    pair = F.struct("question", "answer")
    weights = train.groupBy("cluster_id").agg(F.to_json(F.array_sort(F.collect_set(pair))).cast("binary").alias("data"))
    rows = again.withColumn("steps", F.array_append("steps", F.lit("training"))).join(recalls(held_out, train), "cluster_id", "left")
    if probes is not None:
        rows = rows.join(regressions(again, train, probes), "cluster_id", "left")
    else:
        rows = rows.withColumn("regression", F.lit(0.0))
    if siblings is not None:
        both = train.select("cluster_id", "question", "answer").unionByName(siblings.select("cluster_id", "question", "answer").join(again.select("cluster_id"), "cluster_id", "left_semi"))
        rows = rows.join(recalls(held_out, both).withColumnRenamed("recall", "merged"), "cluster_id", "left")
        rows = rows.withColumn("interference", F.greatest(F.lit(0.0), F.col("recall") - F.col("merged"))).drop("merged")
    else:
        rows = rows.withColumn("interference", F.lit(0.0))
    rows = rows.na.fill(0.0, ["recall", "regression", "interference"])
    reasons = parametric.promotion_reasons(F.col("recall"), F.col("regression"), F.col("interference"), gates.recall, gates.regression, gates.interference)
    rows, refused = _judged(rows, "promotion_gate", reasons, "gate")
    out.append(refused)

    rows = rows.withColumn("adapter_id", F.concat_ws(".", "tenant_scope", "domain", F.col("cluster_id").cast("string")))
    last = adapters.records(reg).groupBy("adapter_id").agg(F.max("version").alias("last"))
    documents = held.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.col("document_id").cast("string"))).alias("source_document_ids"))
    rows = rows.join(last, "adapter_id", "left").withColumn("version", (F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    rows = cut(rows.join(documents, "cluster_id").join(weights, "cluster_id"), "adapters")
    new = rows.select("adapter_id", "version", "tenant_scope", "domain", F.round("coherence", 3).alias("weight"), "centroid", "source_document_ids", F.lit(now_ms).cast("long").alias("created_at_ms"), "data")
    if not rows.isEmpty():
        reg = adapters.with_status(adapters.registered(reg, new), new, "shadow", now_ms)
    out.append(rows.withColumn("steps", F.concat("steps", F.array(F.lit("registered"), F.lit("shadow")))).withColumn("reasons", F.array().cast("array<string>")))

    report = None
    for part in out:
        for name, kind in (("adapter_id", "string"), ("version", "int"), *((r, "long") for r in REASONS), *((m, "double") for m in ("recall", "regression", "interference"))):
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast(kind))
        part = part.select("cluster_id", "steps", F.col("reasons").alias("refused"), *REASONS, "recall", "regression", "interference", "adapter_id", "version")
        report = part if report is None else report.unionByName(part)
    return reg, report
