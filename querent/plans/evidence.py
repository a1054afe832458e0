"""Queries over evidence grouping, lineage, budgets, packing and rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import context, evidence
from querent.sources import catalog
from querent.sources.shared import cut

from . import base
from .base import query
from .retrieval import _BM25, reranked

_WORDS = f"list_distinct(list_filter(string_split({base.normalized('text')}, ' '), lambda w: w <> ''))"


@query(
    f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents), c AS MATERIALIZED (SELECT list_sort(words) AS words, min(doc_id) AS id FROM w WHERE len(words) > 0 GROUP BY 1)
SELECT a.id AS left_id, b.id AS right_id, round({base.jaccard("a.words", "b.words")}, 6) AS overlap FROM c a JOIN c b ON a.id < b.id AND least(len(a.words), len(b.words)) >= 0.85::double * greatest(len(a.words), len(b.words)) - 1e-9
WHERE {base.jaccard("a.words", "b.words")} >= 0.85::double"""
)
def near_dup_pairs(spark, sf_dir):
    return evidence.near_duplicate_pairs(catalog.table(spark, sf_dir, "documents"), "doc_id")


@query(f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(words)) AS class_id FROM (SELECT doc_id, {_WORDS} AS words FROM documents) WHERE len(words) > 0""")
def near_dup_members(spark, sf_dir):
    """The class of every document in near_dup_pairs: exact copies, and links of copies that do not stand for their class."""
    return evidence.word_set_classes(catalog.table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


@query(f"SELECT sha256({base.normalized('text')}) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def fingerprint_groups(spark, sf_dir):
    return catalog.table(spark, sf_dir, "documents").groupBy(text.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


_ROOTS = f"roots AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({base.normalized('text')})) AS lineage_root FROM documents)"


def roots(spark, sf_dir):
    """doc_id and the least doc_id of equal normalised text: aggregated first, so that a large group is not gathered."""
    prints = catalog.table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("print"))
    return prints.join(prints.groupBy("print").agg(F.min("doc_id").alias("lineage_root")), "print").select("doc_id", "lineage_root")


def with_roots(spark, sf_dir, rows):
    """Rows of documents (stored; with their text) with the lineage_root that roots() gives them. Only documents of a text
    that is among the rows are grouped, so a pass over the documents is all that grows with them."""
    rows = rows.withColumn("print", text.fingerprint(F.col("text")))
    wanted = rows.select("print").distinct()
    wanted = F.broadcast(wanted) if rows.count() <= evidence.SENT else wanted
    prints = catalog.table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("print"))
    least = cut(prints.join(wanted, "print", "left_semi").groupBy("print").agg(F.min("doc_id").alias("lineage_root")), "roots")
    return rows.join(least, "print").drop("print")


@query(_BM25.replace("labels AS", f"{_ROOTS}, labels AS") + "SELECT query_id, chunk_id, lineage_root, row_number() OVER (PARTITION BY query_id, lineage_root ORDER BY final_rank) = 1 AS independent FROM final JOIN roots ON doc_id = chunk_id")
def lineage_independence(spark, sf_dir):
    rows = with_roots(spark, sf_dir, reranked(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("query_id", "lineage_root").orderBy("final_rank")) == 1
    return rows.select("query_id", "chunk_id", "lineage_root", first.alias("independent"))


#: Each document stems from that of a third of its id; the first three, and those from 30 to 34, stem from each other in a circle.
_PARENT = "CASE WHEN doc_id < 3 THEN (doc_id + 1) % 3 WHEN doc_id BETWEEN 30 AND 34 THEN 30 + (doc_id - 29) % 5 ELSE {third} END"
_EDGES = f"edges AS (SELECT doc_id AS child, {_PARENT.format(third='doc_id // 3')} AS parent FROM documents)"


def _edges(spark, sf_dir):
    return catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("child"), F.expr(_PARENT.format(third="doc_id div 3")).alias("parent"))


@query(
    f"""WITH RECURSIVE {_EDGES}, up(child, node, path) AS (SELECT child, child, []::bigint[] FROM edges
  UNION ALL SELECT up.child, e.parent, list_append(path, node) FROM up JOIN edges e ON e.child = up.node WHERE NOT list_contains(path, node))
SELECT child, node AS root FROM up WHERE list_contains(path, node)"""
)
def lineage_roots(spark, sf_dir):
    return evidence.lineage_roots(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT parent AS node, child FROM edges WHERE parent IN (SELECT doc_id FROM labels WHERE quality = 1)")
def lineage_children(spark, sf_dir):
    good = catalog.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("node"))
    return evidence.children_of(_edges(spark, sf_dir), good)


@query(_BM25 + "SELECT query_id, chunk_id, CASE WHEN final_rank % 2 = 0 THEN final_rank // 2 ELSE count(*) OVER (PARTITION BY query_id) - 1 - final_rank // 2 END AS place FROM final")
def edge_weighted_order(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return reranked(spark, sf_dir).select("query_id", "chunk_id", evidence.edge_weighted_place(F.col("final_rank"), n).alias("place"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, {base.token_estimate("text")}::int AS q, 1000 + (conv_id % 9)::int * 800 AS win FROM conversations), r AS (SELECT *, 512 + q + floor(400 * 1.25)::int AS reserved FROM t)
SELECT conv_id, turn, floor(400 * 1.25)::int AS output_reserve, reserved >= win AS overflow, CASE WHEN reserved < win THEN least(2000, win - reserved) END AS memory,
  CASE WHEN reserved < win THEN least(win - reserved - least(2000, win - reserved), floor(8000 * CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.5 END)::int) END AS evidence FROM r"""
)
def region_alloc(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "conversations")
    window = (F.lit(1000) + (F.col("conv_id") % 9).cast("int") * 800).cast("int")
    made = evidence.region_budgets(window, F.lit(512), text.token_estimate(F.col("text")).cast("int"), F.lit(400), F.when(F.col("turn") % 2 == 0, 1.0).otherwise(0.5))
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in made.items()])


@query(
    _BM25
    + f"""SELECT query_id, chunk_id, len(a) AS n_aspects, len(list_filter(a, lambda x: contains(lower(text), x))) AS n_covered FROM (
  SELECT query_id, chunk_id, text, {base.content("query_text", text.LEXICAL, text.PACK_STOP, 3)} AS a FROM final JOIN queries USING (query_id) JOIN (SELECT doc_id, text FROM docs) ON doc_id = chunk_id)"""
)
def aspect_coverage(spark, sf_dir):
    wanted = catalog.queries(spark, sf_dir).select("query_id", evidence.aspects(F.col("query_text")).alias("a"))
    rows = reranked(spark, sf_dir).join(wanted, "query_id")
    return rows.select("query_id", "chunk_id", F.size("a").cast("long").alias("n_aspects"), F.size(evidence.covered_aspects(F.col("text"), F.col("a"))).cast("long").alias("n_covered"))


def grouped(spark, sf_dir, pool=None):
    rows = with_roots(spark, sf_dir, pool or reranked(spark, sf_dir))
    return evidence.leader_groups(rows.withColumn("effective_score", F.coalesce("rerank_score", "fused_score")))


@query()
def evidence_groups(spark, sf_dir):
    """A fold whose members depend on earlier groups is beyond SQL; tests hold the brute force."""
    return grouped(spark, sf_dir)


def _candidates(spark, sf_dir, *more):
    """Groups of each query as packing takes them, with further columns of their representatives."""
    wanted = catalog.queries(spark, sf_dir).select("query_id", evidence.aspects(F.col("query_text")).alias("a"))
    pool = reranked(spark, sf_dir)
    shown = pool.select("query_id", F.col("chunk_id").alias("representative"), "text", "source_id", F.coalesce("rerank_score", "fused_score").alias("score"))
    rows = grouped(spark, sf_dir, pool).join(shown, ["query_id", "representative"]).join(wanted, "query_id")
    return rows.select(
        "query_id",
        F.col("group_no").cast("int").alias("group_no"),
        text.token_estimate(F.col("text")).alias("tokens"),
        "score",
        "authority",
        F.lit(0.5).alias("freshness"),
        text.content(F.col("text"), text.LEXICAL, text.PACK_STOP).alias("words"),
        evidence.covered_aspects(F.col("text"), F.col("a")).alias("found"),
        F.size("a").alias("n_aspects"),
        *more,
    )


@query()
def pack_evidence(spark, sf_dir):
    """Greedy packing depends on what is packed already; tests hold the brute force."""
    return evidence.pack_evidence(_candidates(spark, sf_dir), 1500)


@query(
    _BM25
    + """SELECT query_id, string_agg(printf('[E%d] (source=%s document=%s version=v1 authority=%.2f)', final_rank + 1, source_id, chunk_id::varchar, authority) || chr(10) || text, chr(10) || chr(10) ORDER BY final_rank) AS rendered
FROM final JOIN docs ON doc_id = chunk_id GROUP BY query_id"""
)
def render_evidence(spark, sf_dir):
    block = evidence.rendered(F.concat(F.lit("E"), F.col("final_rank") + 1), F.col("source_id"), F.col("chunk_id").cast("string"), F.lit("v1"), F.col("authority"), F.col("text"))
    rows = reranked(spark, sf_dir).select("query_id", F.struct("final_rank", block.alias("block")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b")).select("query_id", F.array_join("b.block", "\n\n").alias("rendered"))


@query()
def built_contexts(spark, sf_dir):
    """Greedy packing and a fold are beyond SQL; tests hold the brute force. Every third query is degraded to half its
    evidence; a conversation's turns are what is remembered for the query of its number."""
    n = F.col("query_id")
    asked = catalog.queries(spark, sf_dir).select("query_id", "query_text", F.lit(8192).alias("context_window"), F.when(n % 3 == 0, 0.5).otherwise(1.0).alias("multiplier"))
    groups = _candidates(spark, sf_dir, "marker", "representative", "source_id", "text").withColumnRenamed("representative", "document_id")
    groups = cut(groups.withColumn("version", F.lit("v1")), "groups")
    turns = catalog.table(spark, sf_dir, "conversations")
    memory = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("long").alias("item_id"), "text", (F.col("turn") % 5 / 5).alias("salience"), F.col("turn").cast("long").alias("created_at_ms"))
    return context.built(asked, groups, memory, "Answer from the evidence and cite it.")
