"""Answers and their grounding: extractive answers, claims, entailment, citations, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text

#: Markers, what is no claim, thresholds and the answers without evidence.
MARKER = r"\[(E\d+)\]"
LEADING = r"^\s*(?:\[E\d+\]\s*)+"
NOT_A_CLAIM = r"^\s*(i (do not|don't|cannot|can't)\b|there (is|are) no\b|based on the (provided|available)\b)"
SUPPORT, MIN_OVERLAP, RELATIVE_FLOOR, MOST_SENTENCES, LEAST_CHARS = 0.75, 0.15, 0.6, 3, 20
NO_EVIDENCE, NO_ANSWER = "I do not have evidence in context to answer that.", "The retrieved evidence does not address that question."


def answer_words(body: Column) -> Column:
    return text.with_stems(text.content(body, text.CLAIM, text.ANSWER_STOP, 3))


def extractive_answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Up to three sentences of each query's evidence (query_id, marker, text) that share most of its words."""
    asked = queries.select("query_id", answer_words(F.col("query_text")).alias("asked"))
    lines = evidence.select("query_id", "marker", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("query_id", "marker", F.explode(text.sentences(F.trim("line"))).alias("s")).select("query_id", "marker", F.trim("s").alias("s"))
    rows = rows.where(F.length("s") >= LEAST_CHARS).withColumn("held", answer_words(F.col("s"))).where(F.size("held") > 0)
    rows = rows.join(asked, "query_id").withColumn("overlap", F.round(text.covered(F.col("asked"), F.col("held")), 6)).where(F.col("overlap") >= MIN_OVERLAP)
    rows = rows.withColumn("sentence", F.concat("s", F.lit(" ["), "marker", F.lit("]")))
    every = Window.partitionBy("query_id")
    # only the best sentences of a query are ranked: the cut comes first
    rows = rows.withColumn("best", F.max("overlap").over(every)).where(F.col("overlap") >= F.col("best") * RELATIVE_FLOOR)
    rows = rows.withColumn("n", F.row_number().over(every.orderBy(F.desc("overlap"), "sentence"))).where(F.col("n") <= MOST_SENTENCES)
    said = rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "sentence")))["sentence"], " ").alias("answer"))
    some = evidence.select("query_id").distinct().withColumn("some", F.lit(True))
    out = queries.select("query_id").join(some, "query_id", "left").join(said, "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.when(F.col("some"), NO_ANSWER).otherwise(NO_EVIDENCE)).alias("answer"))


def claims(answers: DataFrame, id_col: str = "query_id", text_col: str = "answer") -> DataFrame:
    """Sentences of each answer in order; markers at a sentence's head belong to the claim before it."""
    parts = F.filter(text.sentences(F.col(text_col)), lambda s: F.trim(s) != "")
    rows = answers.select(id_col, F.posexplode(parts).alias("n", "raw"))
    lead = F.when(F.col("n") > 0, F.regexp_extract("raw", LEADING, 0)).otherwise("")
    rows = rows.withColumn("lead", lead).withColumn("own", F.trim(F.substring("raw", F.length("lead") + 1, 1 << 30)))
    after = F.lead("lead").over(Window.partitionBy(id_col).orderBy("n"))
    rows = rows.withColumn("tail", F.coalesce(F.trim(after), F.lit("")))
    rows = rows.where(F.col("own") != "").withColumn("text", F.trim(F.concat_ws(" ", "own", F.nullif("tail", F.lit("")))))
    return rows.select(id_col, "n", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))).alias("markers"))


def substantive(claim: Column) -> Column:
    """Whether a claim asserts something."""
    c = F.trim(claim)
    return (F.length(c) >= 12) & ~c.endswith("?") & ~c.rlike(f"(?i){NOT_A_CLAIM}")


def grounding_words(body: Column) -> Column:
    return text.content(F.regexp_replace(F.lower(body), r"\[(e\d+)\]", " "), text.CLAIM, text.GROUNDING_STOP, 2)


def verified(claim_rows: DataFrame, groups: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """Best support of each substantive claim (query_id, n, text, markers) among the groups that it cites (query_id, marker,
    text), or among all of its query where no cited marker is known. Equal scores go to the first group."""
    rows = claim_rows.where(substantive(F.col("text"))).withColumn("words", grounding_words(F.col("text")))
    known = groups.groupBy("query_id").agg(F.collect_set("marker").alias("known"))
    rows = rows.join(known, "query_id", "left").withColumn("cited", F.array_intersect("markers", F.coalesce("known", F.array().cast("array<string>"))))
    held = groups.select("query_id", "marker", F.col("place"), grounding_words(F.col("text")).alias("held"))
    pairs = rows.join(held, "query_id", "left").where((F.size("cited") == 0) | F.array_contains("cited", F.col("marker")) | F.col("marker").isNull())
    score = F.round(F.coalesce(text.covered(F.col("words"), F.col("held")), F.lit(0.0)), 6)
    best = pairs.groupBy("query_id", "n").agg(F.max_by(F.struct(score.alias("score"), "marker"), F.struct(score, (-F.col("place")).alias("early"))).alias("b"))
    return best.select("query_id", "n", "b.score", F.when(F.col("b.score") >= threshold, F.col("b.marker")).alias("marker"), (F.col("b.score") >= threshold).alias("entailed"))


def grounding_report(verdicts: DataFrame) -> DataFrame:
    """Claims, entailed ones and groundedness of each answer with a claim."""
    return verdicts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if("entailed").alias("sourced"),
        F.round(F.avg(F.col("entailed").cast("double")), 6).alias("groundedness"),
    )


def confidence_band(groundedness: Column) -> Column:
    return F.when(groundedness >= 0.9, "high").when(groundedness >= 0.6, "medium").otherwise("low")


def judged_score(reply: Column) -> Column:
    """The last SCORE: of a judge's reply, if it lies within 0 and 1."""
    found = F.regexp_extract_all(reply, F.lit(r"SCORE:\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1)).cast("double")
    return F.when(last.between(0, 1), last)


def buffered_sentences(chunks: DataFrame, by: str, order: str, most: int = 400) -> DataFrame:
    """What a sentence buffer releases from ordered pieces of a stream, white space kept. After each piece, whole sentences
    go; if `most` characters or more are left, all up to the last space go as well. What is left at the end goes last. Null
    pieces are empty, an empty stream releases nothing. A stream's pieces are one answer's, so they fold in one row."""
    whole = lambda held: F.regexp_extract_all(held, F.lit(r"(?s).*?[.!?]\s+"), F.lit(0))
    rest_of = lambda held: F.substring(held, F.length(F.array_join(whole(held), "")) + 1, F.length(held))

    def fed(state: Column, piece: Column) -> Column:
        held = F.concat(state["held"], F.coalesce(piece["piece"], F.lit("")))
        rest = rest_of(held)
        back = F.locate(" ", F.reverse(rest))
        cut = F.when((F.length(rest) >= most) & (back > 0) & (back < F.length(rest)), F.length(rest) - back + 1).otherwise(0)
        early = F.when(cut > 0, F.array(F.left(rest, cut))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.substring(rest, cut + 1, F.length(rest)).alias("held"), F.concat(state["released"], whole(held), early).alias("released"))

    rows = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "piece"))).alias("p"))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("released"))
    last = lambda s: F.when(s["held"] != "", F.array_append(s["released"], s["held"])).otherwise(s["released"])
    return rows.select(by, F.posexplode(F.aggregate("p", start, fed, last)).alias("place", "released")).withColumn("place", F.col("place") + 1)
