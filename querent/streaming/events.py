"""Structured Streaming over the events table: drift monitor, breaker, deduplication, windows, sessions, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from querent.operators.fusion import DEMOTE_ABOVE, MONITOR_LEAST, MONITOR_WINDOW, RETRAIN_ABOVE

BREAKER_FAILURES, BREAKER_COOLDOWN_S = 5, 30


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its time stamps carry a zone, as watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a table may be one file or a folder of files; a stream reads files by a pattern
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as far as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("starts"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "n")


def drift_monitor(events: DataFrame) -> DataFrame:
    """Decisions on each adapter's attempts: its last MONITOR_WINDOW outcomes and a sticky flag are the state."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcomes, demoted = (list(map(int, state.get[0])), state.get[1]) if state.exists else ([], False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, bad in zip(rows["event_id"], rows["conflicted"], strict=True):
            outcomes = [*outcomes, int(bad)][-MONITOR_WINDOW:]
            rate = sum(outcomes) / len(outcomes)
            enough = len(outcomes) >= MONITOR_LEAST
            demoted = demoted or (enough and rate > DEMOTE_ABOVE)
            out.append((key[0], event_id, len(outcomes), rate, "demote" if demoted else "retrain" if enough and rate > RETRAIN_ABOVE else "keep"))
        state.update(("".join(map(str, outcomes)), demoted))
        yield pd.DataFrame(out, columns=["adapter", "event_id", "n", "rate", "action"])

    rows = events.select((F.col("user_id") % 20).alias("adapter"), "event_id", "ts", (F.col("event_type") == "error").alias("conflicted"))
    return rows.groupBy("adapter").applyInPandasWithState(decide, "adapter long, event_id long, n long, rate double, action string", "outcomes string, demoted boolean", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame) -> DataFrame:
    """Whether a source's circuit is open at each call: it opens at BREAKER_FAILURES failures in a row, and after the
    cooldown it lets one call through."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, at, failed in zip(rows["event_id"], rows["ts"].astype("int64") / 1e9, rows["failed"], strict=True):
            if opened >= 0 and at - opened >= BREAKER_COOLDOWN_S:
                failures, opened = BREAKER_FAILURES - 1, -1.0
            is_open = opened >= 0
            out.append((key[0], event_id, is_open))
            if not is_open:
                failures = failures + 1 if failed else 0
                if failures >= BREAKER_FAILURES:
                    opened = at
        state.update((failures, opened))
        yield pd.DataFrame(out, columns=["source_id", "event_id", "is_open"])

    rows = events.select((F.col("user_id") % 5).alias("source_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") > 60).alias("failed"))
    return rows.groupBy("source_id").applyInPandasWithState(follow, "source_id long, event_id long, is_open boolean", "failures long, opened double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, with its checkpoint and its rows in `folder`, and reads the rows back.

    Append mode goes to Parquet. Complete mode replaces the rows with each batch."""
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/rows")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")
