"""Exact top-k lexical search that scores few pairs in full: bounds first.

From the postings of a query set come rows of chunks, with the length and the count of each query term. Of the terms the 64 most frequent ones are bits of a mask of each chunk; they are never a join key, so no term that most texts have
is a hot one. The others are rare.

1. Rare terms of the queries meet the chunks by a join on the term. A pair found has its exact score of rare terms, and as
   its mask tells which common terms it shares, an upper bound: each of these gains at most what it gains in any chunk of
   the same band of length (a table of 64 terms by 64 bands).
2. The pairs of greatest bounds of each query (twice as many as are wanted) are scored in full; the k-th of these scores is
   a threshold that the k-th best cannot be below.
3. Pairs whose bound reaches the threshold are scored in full, by the counts of the common terms in the chunk. Chunks that share no rare term
   with a query are looked at in the bands where the common terms alone could reach its threshold; masks tell which.

So the rows are those of scoring all pairs. For the overlap of words, bits count exactly.
Ties at the threshold are kept (scores are rounded to six places, EDGE is above that). Queries without tokens find nothing;
neither do terms that no chunk has. Chunks of null text are chunks without words; repeated ids are not folded. Repeated
queries of one query_id count as one query of all their tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators.retrieval import B, K1, TOP_K, gain, idf
from querent.sources.shared import cut

#: Bits of a mask, and bands of lengths: three for each doubling.
BITS, BANDS = 64, 64
EDGE = 2e-6
#: Postings of the query terms from which bounds pay: below it scoring all pairs takes less time than the further steps.
LARGE = 20_000_000
#: Rows of a small side that may be broadcast, counted.
SENT = 200_000


def rows_of(held: DataFrame) -> DataFrame:
    """retrieval.postings() as stored rows of chunks: chunk_id, owner, acl_hash, length, n_words and the map of the query
    terms in it to their counts, empty where it has none."""
    rows = held.groupBy("chunk_id", "owner", "acl_hash", "length", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    return cut(rows.withColumn("terms", F.map_filter("terms", lambda t, _: t != "")), "chunk_rows")


def _sent(rows: DataFrame) -> DataFrame:
    """rows (stored), with a broadcast hint if counted few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


@dataclass(frozen=True)
class Pool:
    """What both rankings start from."""

    heads: DataFrame  # a row for each chunk, with its mask, its band and the counts of the common terms by bit
    asked: DataFrame  # a row for each query: bits and weights of its common terms
    pairs: DataFrame  # pairs that share a rare term, with its exact part of the score
    best: DataFrame  # one row: most[bit][band], shortest[band] and mean_length


def pool(queries: DataFrame, rows: DataFrame, k1: float = K1, b: float = B) -> Pool:
    stats = cut(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length")), "stats")
    postings = rows.select("chunk_id", "length", F.explode("terms").alias("term", "tf"))
    df = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    common = [r.term for r in df.orderBy(F.desc("df"), "term").limit(BITS).collect()]
    bits = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(common)], "term string, bit int")

    band = F.least(F.lit(BANDS - 1), F.floor(3 * F.log2(F.col("length") + 1.0)).cast("int"))
    mask = F.lit(0).cast("long")
    for k in range(len(common)):
        mask = mask.bitwiseOR(F.when(F.get("tfs", F.lit(k)) > 0, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    tfs = F.array(*[F.coalesce(F.element_at("terms", F.lit(t)), F.lit(0)).cast("int") for t in common]).cast("array<int>")
    heads = cut(rows.withColumns({"band": band, "tfs": tfs}).drop("terms").withColumn("mask", mask), "heads")

    gains = postings.withColumn("band", band).where(F.col("term").isin(common)).crossJoin(F.broadcast(stats))  # one row
    most = gains.join(F.broadcast(bits), "term").groupBy("bit", "band").agg(F.max(gain(k1, b)).alias("most"))  # BITS by BANDS
    short = heads.groupBy("band").agg(F.min("n_words").alias("shortest"))
    # arrays, as a look-up in a map takes time in proportion to its size
    most = most.agg(F.map_from_entries(F.collect_list(F.struct(F.col("bit") * BANDS + F.col("band"), "most"))).alias("m"))
    short = short.agg(F.map_from_entries(F.collect_list(F.struct("band", "shortest"))).alias("s"))
    filled = lambda name, n, zero: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at(name, k), zero))
    best = cut(most.crossJoin(short).crossJoin(stats).select(filled("m", BITS * BANDS, F.lit(0.0)).alias("most"), filled("s", BANDS, F.lit(1)).alias("shortest"), "mean_length"), "best")

    terms = queries.select("query_id", "tenant_id", "acl_hashes", F.explode(text.tokens(F.col("query_text"))).alias("term"))
    terms = terms.groupBy("query_id", "tenant_id", "acl_hashes", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = terms.join(df, "term", "left").join(F.broadcast(bits), "term", "left").crossJoin(F.broadcast(stats))
    terms = cut(terms.select("query_id", "tenant_id", "acl_hashes", "term", "bit", (F.col("times") * idf()).alias("weight")), "terms")
    asked = terms.groupBy("query_id", "tenant_id", "acl_hashes").agg(
        F.count(F.lit(1)).alias("n_asked"),
        F.collect_list(F.when(F.col("bit").isNotNull(), F.struct("bit", "weight"))).alias("commons"),
    )
    asked = cut(asked, "asked")

    rare = rows.select("chunk_id", "owner", "acl_hash", "length", F.explode("terms").alias("term", "tf")).where(~F.col("term").isin(common))
    hits = rare.join(_sent(terms.where("bit is null and weight is not null")), "term")
    hits = hits.where((F.col("owner") == F.col("tenant_id")) & F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash")))
    hits = hits.crossJoin(F.broadcast(stats))
    pairs = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * gain(k1, b)).alias("part"), F.count(F.lit(1)).alias("rare"))
    pairs = pairs.join(heads.select("chunk_id", "mask", "band", "n_words"), "chunk_id")
    return Pool(heads, asked, cut(pairs, "pairs"), best)


def _has(bit) -> Column:
    return F.bit_get("mask", bit) == 1


def _common_bound(commons: Column, every: bool = False) -> Column:
    """The most that the common terms of a query can add in a chunk of the band: those of its mask, or all."""
    most = lambda c: F.get("most", c["bit"] * BANDS + F.col("band")) * c["weight"]
    return F.aggregate(commons, F.lit(0.0), lambda s, c: s + (most(c) if every else F.when(_has(c["bit"]), most(c)).otherwise(F.lit(0.0))))


def _top(pairs: DataFrame, k: int, by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _thresholds(scores: DataFrame, k: int) -> DataFrame:
    """The k-th score of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return cut(scores.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("threshold")), "thresholds")


def _unmet(p: Pool, thresholds: DataFrame, bound: Column, exact: Column) -> DataFrame:
    """Pairs in scope of the bands where common terms alone may reach a query's threshold, and whose own bits may. Pairs
    that share a rare term too come again. bound: of a query and a band; exact: of a pair by its mask."""
    bands = p.heads.select("band").distinct()  # BANDS at most
    some = p.asked.where(F.size("commons") > 0).join(_sent(thresholds), "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    some = some.crossJoin(F.broadcast(bands)).crossJoin(F.broadcast(p.best)).withColumn("reach", bound).where((F.col("reach") > 0) & (F.col("reach") >= F.col("threshold") - EDGE))
    some = cut(some.select("query_id", F.col("tenant_id").alias("owner"), "band", "acl_hashes", "commons", "n_asked", "threshold"), "bands")
    found = p.heads.join(_sent(some), ["owner", "band"]).where(F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash")))
    found = found.crossJoin(F.broadcast(p.best)).withColumn("bound", exact)
    return found.where((F.col("bound") > 0) & (F.col("bound") >= F.col("threshold") - EDGE))


def _scored(p: Pool, pairs: DataFrame, k1: float, b: float) -> DataFrame:
    """The whole BM25 score of each pair (query_id, chunk_id, part): its part of rare terms, and common ones by their counts."""
    pairs = _sent(cut(pairs.select("query_id", "chunk_id", "part"), "scored"))
    rows = p.heads.select("chunk_id", "length", "tfs").join(pairs, "chunk_id").join(_sent(p.asked.select("query_id", "commons")), "query_id")
    rows = rows.crossJoin(F.broadcast(p.best.select("mean_length")))
    rows = rows.withColumn("norm", k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    tf = lambda c: F.get("tfs", c["bit"])
    score = F.col("part") + F.aggregate("commons", F.lit(0.0), lambda s, c: s + c["weight"] * tf(c) * (k1 + 1) / (tf(c) + F.col("norm")))
    return rows.select("query_id", "chunk_id", F.round(score, 6).alias("score")).where("score > 0")


def bm25_top(p: Pool, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score and rank (from 0) of the k best chunks of each query; ties go to the smaller id."""
    return _ranked(_scored(p, bm25_candidates(p, k, k1, b), k1, b), k)


def bm25_candidates(p: Pool, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    """Pairs that are scored in full: all that can be among the k best."""
    pairs = p.pairs.join(_sent(p.asked.select("query_id", "commons")), "query_id").crossJoin(F.broadcast(p.best))
    pairs = cut(pairs.select("query_id", "chunk_id", "part", (F.col("part") + _common_bound(F.col("commons"))).alias("bound")), "bounds")
    thresholds = _thresholds(_scored(p, _top(pairs, 2 * k, "bound"), k1, b), k)
    kept = pairs.join(_sent(thresholds), "query_id", "left").where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - EDGE))
    more = _unmet(p, thresholds, _common_bound(F.col("commons"), every=True), _common_bound(F.col("commons")))
    rows = kept.select("query_id", "chunk_id", "part").unionByName(more.select("query_id", "chunk_id", F.lit(0.0).alias("part")))
    return rows.groupBy("query_id", "chunk_id").agg(F.max("part").alias("part"))


def overlap_top(p: Pool, k: int = TOP_K) -> DataFrame:
    """The k chunks of each query of the greatest Jaccard overlap of words, among those that share one."""
    both = lambda: F.size(F.filter("commons", lambda c: _has(c["bit"])))
    share = lambda n, words: n / (F.col("n_asked") + words - n)
    asked = _sent(p.asked.select("query_id", "commons", "n_asked"))
    met = p.pairs.join(asked, "query_id").withColumn("both", F.col("rare") + both())
    met = cut(met.select("query_id", "chunk_id", F.round(share(F.col("both"), F.col("n_words")), 6).alias("score")), "overlaps")
    all_common = F.size("commons")
    more = _unmet(p, _thresholds(met, k), share(all_common, F.greatest(F.get("shortest", F.col("band")), all_common)), share(both(), F.col("n_words")))
    # pairs that share a rare term have been met, with a higher score
    rows = met.unionByName(more.select("query_id", "chunk_id", F.round("bound", 6).alias("score"))).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return _ranked(rows, k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
