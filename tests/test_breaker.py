"""The breaker's state machine, over several triggers, against plain Python."""

import datetime
import json
import random

from pyspark.sql import functions as F

from querent.streaming import events as ev


def plain(rows):
    out = []
    for source in sorted({r["user_id"] % 5 for r in rows}):
        failures, opened = 0, None
        for r in sorted((r for r in rows if r["user_id"] % 5 == source), key=lambda r: (r["ts"], r["event_id"])):
            at = datetime.datetime.fromisoformat(r["ts"]).timestamp()
            if opened is not None and at - opened >= ev.BREAKER_COOLDOWN_S:
                failures, opened = ev.BREAKER_FAILURES - 1, None  # one call is let through
            out.append((source, r["event_id"], opened is not None))
            if opened is None:
                failures = failures + 1 if r["value"] > 60 else 0
                if failures >= ev.BREAKER_FAILURES:
                    opened = at
    return sorted(out)


def test_breaker_matches_plain_python(spark, tmp_path):
    rng, at, rows = random.Random(2), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC), []
    for k in range(600):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 2, 15]))
        rows.append({"event_id": k, "ts": at.isoformat(), "user_id": rng.randrange(7), "value": rng.choice([10.0, 90.0, 95.0, 99.0])})
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 200 : (k + 1) * 200]))
        stream = spark.readStream.schema("event_id long, ts string, user_id long, value double").option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
        got = ev.run_to_table(ev.breaker(stream), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == plain(rows) and any(r.is_open for r in got.collect())
