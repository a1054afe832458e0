"""The parametric route: questions that adapters answer confidently and evidence does not contradict are served from there,
and the evidence plan runs for the others alone.

A question declines before evidence is looked at if no adapter was selected (`no_adapter_selected`), or if its answer is blank
or its confidence, the mean of the best coverage and the answer's score, is under the floor
(`parametric_confidence_below_floor`). What is left is checked against evidence retrieved for these questions: a claim that
evidence contradicts and nothing backs (`parametric_contradicted`) sends the question on as well. In a served answer each
substantive claim has the citation of the group that entails it, or is marked as unsourced.

The two plans are functions from questions to rows, so what they scan, join and score is cut to the questions that need
them. Questions are stored after each decision, with a row for each. Null and empty answers are blank. A question asked
twice under one query_id is one question. No questions give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import grounding, serving
from querent.sources.shared import cut

CONFIDENCE = 0.6
UNSOURCED = " [unsourced]"
NO_ADAPTER, UNSURE, CONTRADICTED = "no_adapter_selected", "parametric_confidence_below_floor", "parametric_contradicted"


def gated(questions: DataFrame, selected: DataFrame, answers: DataFrame, floor: float = CONFIDENCE) -> DataFrame:
    """query_id, adapter_id, answer, confidence and the reason to decline, if any. selected: query_id, adapter_id, coverage;
    answers: query_id, adapter_id, score, answer."""
    rows = selected.join(answers, ["query_id", "adapter_id"]).withColumnRenamed("query_id", "request_id")
    pick = serving.composed(rows.select("request_id", "adapter_id", "coverage", "score", "answer")).withColumnRenamed("request_id", "query_id")
    said = pick.join(answers.select("query_id", "adapter_id", "answer"), ["query_id", "adapter_id"])
    best = selected.groupBy("query_id").agg(F.max("coverage").alias("coverage"))
    out = questions.select("query_id").distinct().join(best, "query_id", "left").join(said, "query_id", "left")
    confidence = F.round((F.col("coverage") + F.coalesce("score", F.lit(0.0))) / 2, 6)
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    reason = F.when(F.col("coverage").isNull(), NO_ADAPTER).when(blank | (confidence < floor), UNSURE)
    return out.select("query_id", "adapter_id", "answer", confidence.alias("confidence"), reason.alias("reason"))


def _marked(answer: Column, claims: Column) -> Column:
    """The answer with a mark behind the first place of each claim."""

    def mark(done: Column, claim: Column) -> Column:
        at = F.position(claim, done)
        end = at - 1 + F.length(claim)
        return F.when(at > 0, F.concat(F.left(done, end), F.lit(UNSOURCED), F.substring(done, end + 1, F.length(done)))).otherwise(done)

    return F.aggregate(claims, answer, mark)


def routed(
    questions: DataFrame,
    selected: DataFrame,
    answers: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    by_evidence: Callable[[DataFrame], DataFrame],
    suffices: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    floor: float = CONFIDENCE,
) -> DataFrame:
    """query_id, answer, route, basis, confidence, reason and citations of each question.

    retrieve: questions to groups (query_id, marker, place, text); by_evidence: questions to query_id, answer; suffices:
    questions and groups to the query_ids whose evidence would do by itself, which makes the basis hybrid."""
    gate = cut(gated(questions, selected, answers, floor), "gate")
    sure = gate.where("reason is null")
    asked = questions.join(sure.select("query_id"), "query_id", "left_semi").dropDuplicates(["query_id"])
    groups = cut(retrieve(asked), "groups")
    claims = cut(grounding.claims(sure.select("query_id", "answer")), "claims")
    lines = groups.select("query_id", "place", F.posexplode(text.sentences(F.col("text"))).alias("k", "s"))
    against = serving.parametric_conflicts(claims.select("query_id", "n", "text"), lines).select("query_id").distinct()
    decided = cut(gate.join(against.withColumn("against", F.lit(True)), "query_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("against"), CONTRADICTED))).drop("against"), "decided")

    served = decided.where("reason is null")
    verdicts = grounding.verified(claims.join(served.select("query_id"), "query_id", "left_semi"), groups).join(claims.select("query_id", "n", "text"), ["query_id", "n"])
    found = verdicts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("entailed"), F.struct("n", "marker", "score")))).alias("citations"),
        F.array_sort(F.collect_list(F.when(~F.col("entailed"), F.struct("n", "text")))).alias("unsourced"),
    )
    served = served.join(found, "query_id", "left")
    if suffices is not None:
        served = served.join(suffices(asked, groups).select("query_id").distinct().withColumn("enough", F.lit(True)), "query_id", "left")
    else:
        served = served.withColumn("enough", F.lit(None).cast("boolean"))
    bare = F.coalesce(F.transform("unsourced", lambda u: u["text"]), F.array().cast("array<string>"))
    cited = F.coalesce("citations", F.array().cast("array<struct<n:int,marker:string,score:double>>"))
    served = served.select("query_id", _marked(F.col("answer"), bare).alias("answer"), F.lit("parametric").alias("route"), F.when(F.col("enough"), "hybrid").otherwise("parametric").alias("basis"), "confidence", "reason", cited.alias("citations"))

    declined = decided.where("reason is not null")
    rest = by_evidence(questions.join(declined.select("query_id"), "query_id", "left_semi").dropDuplicates(["query_id"])).select("query_id", F.col("answer").alias("said"))
    other = declined.join(rest, "query_id", "left")
    none = F.array().cast("array<struct<n:int,marker:string,score:double>>")
    return served.unionByName(other.select("query_id", F.col("said").alias("answer"), F.lit("evidence").alias("route"), F.lit("retrieved_evidence").alias("basis"), F.lit(None).cast("double").alias("confidence"), "reason", none.alias("citations")))
