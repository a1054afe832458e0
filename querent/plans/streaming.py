"""Streaming queries, run over all events that are there, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.sources import catalog
from querent.sources.shared import folder
from querent.streaming import events, memory

from .base import ORACLE_SQL, query
from .deciding import drift_monitor as _  # noqa: F401  its SQL is the stream's too


def _run(spark, sf_dir, make, mode="append"):
    return events.run_to_table(make(events.source(spark, sf_dir)), folder(spark, "stream"), mode)


@query(ORACLE_SQL["drift_monitor"])
def drift_monitor_stream(spark, sf_dir):
    return _run(spark, sf_dir, events.drift_monitor).select("event_id", "adapter", "n", F.round("rate", 6).alias("rate"), "action")


@query("SELECT event_id, user_id, event_type FROM events")
def events_dedup_stream(spark, sf_dir):
    return _run(spark, sf_dir, lambda rows: events.deduplicated(rows.union(rows))).select("event_id", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS starts, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def windowed_counts_stream(spark, sf_dir):
    rows = _run(spark, sf_dir, lambda rows: events.windowed_counts(rows, "6 hours"), "complete")
    return rows.withColumn("starts", F.col("starts").cast("timestamp_ntz"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL '6 hours' AS ends, count(*) AS n FROM s GROUP BY user_id, k"""


def _naive(rows):
    return rows.withColumn("starts", F.col("starts").cast("timestamp_ntz")).withColumn("ends", F.col("ends").cast("timestamp_ntz"))


@query(_SESSIONS)
def session_windows(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy(F.session_window("ts", "6 hours").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return _naive(grouped.select("user_id", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "n"))


@query(_SESSIONS)
def session_windows_stream(spark, sf_dir):
    return _naive(_run(spark, sf_dir, events.sessions, "complete"))


@query()
def breaker_stream(spark, sf_dir):
    """A state machine over time is beyond SQL; tests hold the brute force."""
    return _run(spark, sf_dir, events.breaker)


def memory_events(turns):
    """Turns of conversations as events of long-term memory, a conversation a principal: a user's turn is a question first and
    then what the user asserts; the others are what the model generates."""
    at = F.lit(catalog.CLOCK_MS) + F.col("turn") * 3_600_000
    said = F.when(F.col("role") == "user", "user_asserted").otherwise("model_generated")
    kinds = F.explode(F.when(F.col("role") == "user", F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("write"))))
    null = lambda kind: F.lit(None).cast(kind)
    return turns.select(
        F.col("conv_id").cast("string").alias("principal"), (F.col("conv_id") * 100_000 + F.col("turn") * 2).alias("event_id"), at.alias("at_ms"), kinds.alias("kind"),
        F.concat_ws(":", "conv_id", "turn").alias("item_id"), F.lit("long_term").alias("namespace"), said.alias("provenance"), null("string").alias("session_id"),
        "text", F.lit(0.5).alias("salience"), F.lit(5).alias("most"), null("long").alias("before_ms"),
    ).withColumn("event_id", F.col("event_id") + (F.col("kind") == "write").cast("int"))


@query()
def memory_stream(spark, sf_dir):
    """State that reads change is beyond SQL; tests/test_memory_stream.py holds the brute force."""
    schema = catalog.table(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")
    return events.run_to_table(memory.remembered(memory_events(turns), memory.LONG_TERM), folder(spark, "stream"))
