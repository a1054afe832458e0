"""Retrieval: lexical and dense search within a principal's scope, fusion of rankings, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import blocks
from querent.sources import catalog
from querent.sources.shared import cut

K1, B, TOP_K, RRF_K = 1.2, 0.75, 24, 60
RERANK_INPUT, OUTPUT_K = 30, 8


def postings(queries: DataFrame, chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored postings of the query terms alone, from one pass over the texts: chunk_id, owner, acl_hash, length in tokens and
    distinct words of the chunk, term and tf. Each chunk also has one row of the empty term, which corpus counts come from."""
    terms = queries.select(F.explode(F.array_append(text.tokens(F.col("query_text")), F.lit(""))).alias("term")).distinct()
    words = chunks.select("chunk_id", F.col("tenant_id").alias("owner"), "acl_hash", text.tokens(F.col(text_col)).alias("words"))
    # counted before the words are dealt out, else once for each word
    words = words.select("chunk_id", "owner", "acl_hash", F.size("words").alias("length"), F.size(F.array_distinct("words")).alias("n_words"), F.array_append("words", F.lit("")).alias("words"))
    rows = words.select("chunk_id", "owner", "acl_hash", "length", "n_words", F.explode("words").alias("term"))
    rows = rows.join(terms, "term", "left_semi").groupBy("chunk_id", "owner", "acl_hash", "length", "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))
    return cut(rows, "postings")


def _in_scope(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("owner") == F.col("tenant_id")) & F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash")))


#: Texts without a word of their own inside are sent to the documents up to so many rows and characters, both counted.
SHORT_ROWS, SHORT_CHARS, ANCHOR = 2000, 200_000, 12
#: Rows of items or of documents near them that may be broadcast, counted.
SENT = 200_000
#: Words of a text that are words of any text that holds it: a character that no word has is on either side.
_INNER = r"(?<=[^a-z0-9\-_.])[a-z0-9][a-z0-9\-_.]*(?=[^a-z0-9\-_.])"


def _words_held(wanted: DataFrame, docs: DataFrame, held: tuple[list, DataFrame] | None = None) -> DataFrame:
    """Stored rows of doc_id and each wanted word (word) that is in its text."""
    if held is None:
        wanted = cut(wanted, "wanted")
        if wanted.count() > blocks.MOST_TERMS:
            words = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
            return cut(words.join(wanted, "word", "left_semi"), "words")
        terms = [r.word for r in wanted.collect()]
        held = terms, blocks.counted(docs.select("doc_id", F.lower("text").alias("low")), terms)
    terms, rows = held
    names = rows.sparkSession.createDataFrame([(k, t) for k, t in enumerate(terms)], "term int, word string")
    return rows.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(names), "term").select("doc_id", "word")


def holders(items: DataFrame, docs: DataFrame, held: tuple[list, DataFrame] | None = None) -> DataFrame:
    """query_id and doc_id of each document (doc_id, text) that holds an item's text (query_id, item) as it is.

    Items meet the documents at their rarest inner word, by a join on that word, and are compared in full there. Items of
    one or two words may have none: a counted few are sent to the documents, more are met by their first characters. Null
    and empty items are in no document; null texts hold none. Repeated rows give repeated links. `held`: a list of words that has
    all words of the items, and blocks.counted() of them (doc_id), where they are there already."""
    items = cut(items.where(F.length("item") > 0).select("query_id", "item", F.array_distinct(F.regexp_extract_all(F.lower("item"), F.lit(_INNER), F.lit(0))).alias("inner")), "items")
    docs = docs.select("doc_id", "text")
    asked = items.select("query_id", "item", F.explode("inner").alias("word"))
    words = _words_held(asked.select("word").distinct(), docs, held)
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "word", "left").groupBy("query_id", "item").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "word")).alias("w")).select("query_id", "item", F.col("w.word").alias("word"))
    rarest = cut(rarest, "rarest")
    near = cut((F.broadcast(rarest) if rarest.count() <= SENT else rarest).join(words, "word").select("query_id", "item", "doc_id").distinct(), "near")
    # few documents have an item's rarest word: their texts alone are met, without dealing out those of all
    found = docs.join(F.broadcast(near) if near.count() <= SENT else near, "doc_id").where(F.contains("text", "item")).select("query_id", "doc_id")
    short = items.where(F.size("inner") == 0)
    n, total, width = short.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("item")), F.lit(0)), F.coalesce(F.min(F.length("item")), F.lit(1))).first()
    if not n:
        return found
    if n <= SHORT_ROWS and total <= SHORT_CHARS:
        more = docs.join(F.broadcast(short.select("query_id", "item")), F.contains("text", "item"))
    else:
        width = min(width, ANCHOR)
        windows = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))
        anchored = short.select("query_id", "item", F.substring("item", 1, width).alias("anchor"))
        more = docs.select("*", F.explode(windows).alias("anchor")).join(anchored, "anchor").where(F.contains("text", "item"))
    return found.unionByName(more.select("query_id", "doc_id"))


def bm25(queries: DataFrame, chunks: DataFrame | None, k1: float = K1, b: float = B, held: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of every visible chunk that has a query term; frequencies count over all tenants. `held`:
    postings() of these queries, where they are there already."""
    held = postings(queries, chunks) if held is None else held
    stats = held.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    held = held.where("term <> ''")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return bm25_scores(queries, held.join(df, "term"), stats, k1, b)


def idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def gain(k1: float = K1, b: float = B) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))


def bm25_scores(queries: DataFrame, held: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score from postings of the query terms with their df, and one row of n and mean_length."""
    hits = _in_scope(catalog.query_tokens(queries).join(held, "term")).crossJoin(F.broadcast(stats))  # one row
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(idf() * gain(k1, b)), 6).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, by: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """The best k rows of each query with their rank from 0; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), id_col)
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def vector_search(queries: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """Cosine top-k of each query vector among the points of its tenant that it may see; filters come before scoring."""
    seen = catalog.visible(queries, points)
    scored = seen.select("query_id", "point_id", F.round(text.cosine(F.col("query_vector"), F.col("vector")), 6).alias("score"))
    return top_k(scored, k, id_col="point_id")


def overlap_leg(queries: DataFrame, chunks: DataFrame | None, held: DataFrame | None = None) -> DataFrame:
    """A second ranking: Jaccard overlap of query and chunk words, among chunks that share a query term."""
    held = (postings(queries, chunks) if held is None else held).where("term <> ''")
    asked = queries.select("query_id", "tenant_id", "acl_hashes", F.array_distinct(text.tokens(F.col("query_text"))).alias("asked"))
    terms = asked.select("query_id", "tenant_id", "acl_hashes", F.size("asked").alias("n_asked"), F.explode("asked").alias("term"))
    both = _in_scope(terms.join(held, "term")).groupBy("query_id", "chunk_id", "n_asked", "n_words").agg(F.count(F.lit(1)).alias("both"))
    return both.select("query_id", "chunk_id", F.round(F.col("both") / (F.col("n_asked") + F.col("n_words") - F.col("both")), 6).alias("score"))


def reciprocal_rank_fusion(legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuses rows of query_id, chunk_id, source, rank (from 0), weight and effective_score: the sum of weight / (k + rank + 1)."""
    fused = legs.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank") + 1)), 8).alias("fused_score"),
        F.max("effective_score").alias("best_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "rank")))).alias("rank_by_leg"),
    )
    return fused


def weighted_fusion(legs: DataFrame) -> DataFrame:
    """The sum of weight times effective score."""
    return legs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("effective_score")), 8).alias("fused_score"))


def usable(status: Column) -> Column:
    return status.isin("ok", "partial")


def rerank(queries: DataFrame, candidates: DataFrame, k: int = OUTPUT_K) -> DataFrame:
    """Content-word overlap with a bonus for the fused position; queries without content words keep the input order, unscored."""
    asked = text.content(F.col("query_text"), text.LEXICAL, text.RERANK_STOP, 3)
    held = text.content(F.col("text"), text.LEXICAL, text.RERANK_STOP, 3)
    rows = candidates.join(queries.select("query_id", asked.alias("asked")), "query_id").withColumn("held", held)
    share = F.size(F.array_intersect("asked", "held")) / F.size("asked")
    score = F.when(F.size("asked") > 0, F.round(0.65 * share + 0.35 / (1 + F.col("position")), 8))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "position")
    rows = rows.withColumn("rerank_score", score).withColumn("final_rank", F.row_number().over(order) - 1)
    return rows.where(F.col("final_rank") < k).drop("asked", "held")


def rerank_outcomes(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, ran and skipped_reason: whether each query (with `allowed` and `expired`) is reranked, and why not."""
    some = candidates.select("query_id").distinct().withColumn("some", F.lit(True))
    reason = F.when(~F.col("allowed"), "degraded_budget").when(F.col("some").isNull(), "no_candidates").when(F.col("expired"), "deadline_exceeded")
    return queries.join(some, "query_id", "left").select("query_id", reason.isNull().alias("ran"), reason.alias("skipped_reason"))


def rerank_with_budget(queries: DataFrame, candidates: DataFrame, input_k: int = RERANK_INPUT, k: int = OUTPUT_K) -> DataFrame:
    """Reranks the first input_k candidates of the queries that may be; the others keep the fused order, unscored."""
    rows = candidates.where(F.col("position") < max(input_k, k)).join(rerank_outcomes(queries, candidates), "query_id")
    ranked = rerank(queries, rows.where(F.col("ran") & (F.col("position") < input_k)), k)
    kept = rows.where(~F.col("ran") & (F.col("position") < k)).withColumns({"rerank_score": F.lit(None).cast("double"), "final_rank": F.col("position")})
    return ranked.unionByName(kept)
