"""Memory: live items, recent turns, ranking with decay, merging, forgetting and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.sources.catalog import DAY_MS

RECENT, SUMMARY_CHARS, CAPACITY = 8, 1000, 500
#: Fixed value: the words of a decision.
DECISION = r"\b(chose|choose|decided|decide|agreed|agree|approved|selected|picked|settled on|going with|will use|we'll use|prefer)\b"


def live(items: DataFrame, now_ms: int, ttl_ms: int | None) -> DataFrame:
    """Items that have not expired at the clock."""
    return items if ttl_ms is None else items.where(F.col("created_at_ms") >= now_ms - ttl_ms)


def decayed(now_ms: int, half_life_days: float | None) -> Column:
    """Salience halved for each half-life since the last use."""
    if not half_life_days:
        return F.col("salience")
    since = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.greatest("created_at_ms", F.coalesce("last_accessed_ms", F.lit(0)))) / F.lit(float(DAY_MS)))
    return F.col("salience") * F.pow(F.lit(0.5), since / half_life_days)


def recent(items: DataFrame, window: int = RECENT) -> DataFrame:
    """The last items of each session."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at_ms"), F.desc("item_id")))
    return items.withColumn("_n", n).where(F.col("_n") <= window).drop("_n")


def turn_counts(items: DataFrame, now_ms: int, ttl_ms: int | None) -> DataFrame:
    """Live items of each session, and when the first and last of them were made."""
    return live(items, now_ms, ttl_ms).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.min("created_at_ms").alias("first_ms"), F.max("created_at_ms").alias("last_ms"))


def words(body: Column) -> Column:
    return text.content(body, text.PLAIN, text.MEMORY_STOP, 2)


def ranked(queries: DataFrame, items: DataFrame, now_ms: int, half_life_days: float | None, limit: int, long_term: bool) -> DataFrame:
    """Best items of each query within its session: by word overlap, then decayed salience, then age. Long-term memory needs
    an overlap. queries: query_id, session_id, query_text."""
    asked = queries.select("query_id", "session_id", words(F.col("query_text")).alias("asked"))
    rows = asked.join(items.withColumn("held", words(F.col("text"))), "session_id")
    rows = rows.withColumn("overlap", F.round(text.covered(F.col("asked"), F.col("held")), 6)).withColumn("strength", F.round(decayed(now_ms, half_life_days), 6))
    if long_term:
        rows = rows.where((F.size("asked") == 0) | (F.col("overlap") > 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("strength"), F.desc("created_at_ms"), F.desc("item_id"))
    return rows.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < limit).select("query_id", "item_id", "overlap", "strength", "place")


def merged(items: DataFrame, now_ms: int, half_life_days: float | None, capacity: int = CAPACITY) -> DataFrame:
    """Restated facts as one item with the greatest salience; each principal keeps the strongest `capacity`."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    one = items.groupBy("principal", key.alias("fact")).agg(F.min("item_id").alias("item_id"), F.max("salience").alias("salience"), F.min("created_at_ms").alias("created_at_ms"), F.max("last_accessed_ms").alias("last_accessed_ms"), F.count(F.lit(1)).alias("said"))
    order = Window.partitionBy("principal").orderBy(F.desc(F.round(decayed(now_ms, half_life_days), 9)), F.desc("created_at_ms"), F.desc("item_id"))
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity).drop("place")


def selected(selector: dict) -> Column:
    """Which items a selector means: all its given fields must match; an empty one means none."""
    given = {k: v for k, v in selector.items() if v is not None}
    if not given:
        return F.lit(False)
    out = F.lit(True)
    for k, v in given.items():
        out = out & (F.col("created_at_ms") < v if k == "before_ms" else F.col(k).eqNullSafe(F.lit(v)))
    return out


def forgotten(items: DataFrame, selector: dict) -> DataFrame:
    """Items that stay."""
    return items.where(~F.coalesce(selected(selector), F.lit(False)))


def summaries(turns: DataFrame, window: int = RECENT, most: int = SUMMARY_CHARS) -> DataFrame:
    """First sentences of turns older than the window, joined and cut, and the user's decisions word for word."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    rows = turns.withColumn("back", back)
    old = rows.where(F.col("back") > window).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.get(text.sentences(F.col("text")), F.lit(0)).alias("s")))).alias("old"))
    said = rows.where((F.col("role") == "user") & F.col("text").rlike(f"(?i){DECISION}")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("decisions"))
    return old.join(said, "session_id", "full").select("session_id", F.left(F.array_join("old.s", " "), F.lit(most)).alias("summary"), F.coalesce("decisions", F.array().cast("array<string>")).alias("decisions"))
