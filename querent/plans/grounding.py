"""Queries over answers, claims and their grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import grounding
from querent.sources import catalog

from . import base
from .base import ORACLE_SQL, query
from .retrieval import _BM25, reranked

_AW = lambda c: base.with_stems(base.content(c, text.CLAIM, text.ANSWER_STOP, 3))
_GW = lambda c: base.content(f"regexp_replace(lower({c}), '\\[(e\\d+)\\]', ' ', 'g')", text.CLAIM, text.GROUNDING_STOP, 2)
_ANSWER = (
    _BM25
    + f""", ev AS (SELECT query_id, 'E' || (final_rank + 1) AS marker, final_rank AS place, text FROM final JOIN docs ON doc_id = chunk_id),
ln AS (SELECT query_id, marker, unnest(string_split(text, chr(10))) AS line FROM ev), se AS (SELECT query_id, marker, trim(unnest({base.sentences("trim(line)")})) AS s FROM ln),
hd AS (SELECT *, {_AW("s")} AS held FROM se WHERE length(s) >= 20), aq AS (SELECT query_id, {_AW("query_text")} AS asked FROM queries),
sc AS (SELECT query_id, s || ' [' || marker || ']' AS sentence, round({base.covered("asked", "held")}, 6) AS overlap FROM hd JOIN aq USING (query_id) WHERE len(held) > 0),
kp AS (SELECT * FROM sc WHERE overlap >= 0.15::double QUALIFY overlap >= 0.6::double * max(overlap) OVER (PARTITION BY query_id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, sentence) AS n FROM kp QUALIFY n <= 3),
ans AS (SELECT q.query_id, coalesce(string_agg(sentence, ' ' ORDER BY n), CASE WHEN q.query_id IN (SELECT query_id FROM ev) THEN 'The retrieved evidence does not address that question.' ELSE 'I do not have evidence in context to answer that.' END) AS answer
  FROM queries q LEFT JOIN tp USING (query_id) GROUP BY q.query_id),
pt AS (SELECT query_id, list_filter({base.sentences("answer")}, lambda s: trim(s) <> '') AS p FROM ans), px AS (SELECT query_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS n FROM pt),
ld AS (SELECT *, CASE WHEN n > 0 THEN regexp_extract(raw, '^\\s*(?:\\[E\\d+\\]\\s*)+') ELSE '' END AS ld FROM px),
tl AS (SELECT query_id, n, trim(substr(raw, length(ld) + 1)) AS own, coalesce(trim(lead(ld) OVER (PARTITION BY query_id ORDER BY n)), '') AS tail FROM ld),
cl AS (SELECT query_id, n, trim(concat_ws(' ', own, nullif(tail, ''))) AS text, list_distinct(regexp_extract_all(trim(concat_ws(' ', own, nullif(tail, ''))), '\\[(E\\d+)\\]', 1)) AS markers FROM tl WHERE own <> '')
"""
)


def evidence_rows(spark, sf_dir, held=None):
    rows = reranked(spark, sf_dir, held)
    return rows.select("query_id", F.concat(F.lit("E"), F.col("final_rank") + 1).alias("marker"), F.col("final_rank").alias("place"), "text")


def answers(spark, sf_dir, shown=None):
    shown = evidence_rows(spark, sf_dir) if shown is None else shown
    return grounding.extractive_answers(catalog.queries(spark, sf_dir).select("query_id", "query_text"), shown.select("query_id", "marker", "text"))


@query(_ANSWER + "SELECT query_id, answer FROM ans")
def extractive_answer(spark, sf_dir):
    return answers(spark, sf_dir)


@query(_ANSWER + "SELECT query_id, n, text, array_to_string(list_sort(markers), ',') AS markers FROM cl")
def claims(spark, sf_dir):
    return grounding.claims(answers(spark, sf_dir)).select("query_id", F.col("n").cast("long").alias("n"), "text", F.array_join(F.array_sort("markers"), ",").alias("markers"))


@query(
    _ANSWER
    + f""", sub AS (SELECT *, {_GW("text")} AS words FROM cl WHERE length(trim(text)) >= 12 AND NOT ends_with(trim(text), '?') AND NOT regexp_matches(trim(text), '(?i)^\\s*(i (do not|don''t|cannot|can''t)\\b|there (is|are) no\\b|based on the (provided|available)\\b)')),
gr AS (SELECT query_id, marker, place, {_GW("text")} AS held FROM ev), cite AS (SELECT s.*, list_intersect(markers, (SELECT list(marker) FROM gr WHERE gr.query_id = s.query_id)) AS cited FROM sub s),
pr AS (SELECT c.query_id, c.n, g.marker, g.place, round(coalesce({base.covered("words", "held")}, 0), 6) AS score FROM cite c LEFT JOIN gr g ON c.query_id = g.query_id WHERE len(coalesce(cited, [])) = 0 OR list_contains(cited, g.marker) OR g.marker IS NULL),
bs AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, place) AS k FROM pr QUALIFY k = 1)
SELECT query_id, n, score, CASE WHEN score >= 0.75 THEN marker END AS marker, score >= 0.75 AS entailed FROM bs"""
)
def entailment_best(spark, sf_dir):
    shown = evidence_rows(spark, sf_dir)  # reranked once, for the answers and for what they are held against
    rows = grounding.verified(grounding.claims(answers(spark, sf_dir, shown)), shown)
    return rows.withColumn("n", F.col("n").cast("long"))


@query("SELECT doc_id, len(" + base.sentences("text") + ") AS n_sentences, " + base.token_estimate("text") + " AS tokens, len(" + base.toks("text", text.LEXICAL) + ") AS lexical_tokens FROM documents")
def sentence_and_token_counts(spark, sf_dir):
    t = F.col("text")
    return catalog.table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(t)).cast("long").alias("n_sentences"), text.token_estimate(t).alias("tokens"), F.size(text.tokens(t)).cast("long").alias("lexical_tokens"))


@query("SELECT 'sha256:' || sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(
    """WITH r AS (SELECT conv_id, turn, text || ' SCORE: ' || ((conv_id % 13) / 10.0)::decimal(4,1) || CASE WHEN turn % 3 = 0 THEN ' then SCORE: 0.4' ELSE '' END AS reply FROM conversations), p AS (SELECT *, list_last(regexp_extract_all(reply, 'SCORE:\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1))::double AS s FROM r)
SELECT conv_id, turn, CASE WHEN s BETWEEN 0 AND 1 THEN s END AS judged FROM p"""
)
def judge_scores(spark, sf_dir):
    n = F.format_string("%.1f", (F.col("conv_id") % 13) / 10)
    reply = F.concat("text", F.lit(" SCORE: "), n, F.when(F.col("turn") % 3 == 0, " then SCORE: 0.4").otherwise(""))
    return catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", grounding.judged_score(reply).alias("judged"))


@query()
def sentence_buffer(spark, sf_dir):
    """Release points of a fold; tests hold the brute force."""
    pieces = catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" ")).alias("piece"))
    return grounding.buffered_sentences(pieces, "conv_id", "turn")


@query(
    f"""SELECT *, CASE WHEN groundedness >= 0.9 THEN 'high' WHEN groundedness >= 0.6 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT query_id, count(*) AS claims, count(*) FILTER (entailed) AS sourced, round(avg(entailed::int), 6) AS groundedness FROM ({ORACLE_SQL["entailment_best"]}) GROUP BY query_id)"""
)
def answer_bands(spark, sf_dir):
    """How far each answer's claims are grounded, and the band of confidence that follows."""
    report = grounding.grounding_report(entailment_best(spark, sf_dir))
    return report.withColumn("band", grounding.confidence_band(F.col("groundedness")))
