"""Queries over memory, from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import memory
from querent.sources import catalog

from . import base
from .base import query

_ITEMS = """items AS (SELECT conv_id * 100 + turn AS item_id, conv_id AS session_id, conv_id % 7 AS principal, turn, role, text, 1704067200000 - (conv_id % 40) * 86400000 + turn * 1000 AS created_at_ms,
  CASE WHEN turn % 2 = 0 THEN 1704067200000 - (conv_id % 11) * 86400000 END AS last_accessed_ms, round(0.2::double + 0.1::double * (turn % 8), 6) AS salience FROM conversations WHERE role <> 'system')"""


def items(spark, sf_dir):
    n, t = F.col("conv_id"), F.col("turn")
    return catalog.table(spark, sf_dir, "conversations").where("role <> 'system'").select(
        (n * 100 + t).alias("item_id"), n.alias("session_id"), (n % 7).alias("principal"), "turn", "role", "text",
        (F.lit(catalog.CLOCK_MS) - (n % 40) * catalog.DAY_MS + t * 1000).alias("created_at_ms"),
        F.when(t % 2 == 0, F.lit(catalog.CLOCK_MS) - (n % 11) * catalog.DAY_MS).alias("last_accessed_ms"),
        F.round(F.lit(0.2) + F.lit(0.1) * (t % 8), 6).alias("salience"),
    )


@query(f"WITH {_ITEMS} SELECT item_id, session_id FROM items WHERE created_at_ms >= 1704067200000 - 20 * 86400000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at_ms DESC, item_id DESC) <= 3")
def memory_recent_window(spark, sf_dir):
    rows = memory.live(items(spark, sf_dir), catalog.CLOCK_MS, 20 * catalog.DAY_MS)
    return memory.recent(rows, 3).select("item_id", "session_id")


_MW = lambda c: base.content(c, text.PLAIN, text.MEMORY_STOP, 2)


@query(
    f"""WITH {_ITEMS}, q AS (SELECT session_id AS query_id, session_id, {_MW("text")} AS asked FROM items WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) = 1),
s AS (SELECT q.query_id, i.item_id, created_at_ms, asked, round({base.covered("asked", _MW("i.text"))}, 6) AS overlap,
  round(salience * pow(0.5, greatest(0, (1704067200000 - greatest(created_at_ms, coalesce(last_accessed_ms, 0))) / 86400000.0::double) / 30.0::double), 6) AS strength FROM q JOIN items i ON i.session_id = q.session_id)
SELECT query_id, item_id, overlap, strength, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, strength DESC, created_at_ms DESC, item_id DESC) - 1 AS place FROM s WHERE len(asked) = 0 OR overlap > 0 QUALIFY place < 5"""
)
def memory_rank_decay(spark, sf_dir):
    rows = items(spark, sf_dir)
    last = rows.where("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn").alias("query_text"))
    asked = last.select(F.col("session_id").alias("query_id"), "session_id", "query_text")
    return memory.ranked(asked, rows, catalog.CLOCK_MS, 30.0, 5, long_term=True).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH {_ITEMS}, o AS (SELECT principal, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS fact, min(item_id) AS item_id, max(salience) AS salience, min(created_at_ms) AS created_at_ms, max(last_accessed_ms) AS last_accessed_ms, count(*) AS said FROM items GROUP BY ALL)
SELECT principal, item_id, salience, said FROM o QUALIFY row_number() OVER (PARTITION BY principal ORDER BY round(salience * pow(0.5, greatest(0, (1704067200000 - greatest(created_at_ms, coalesce(last_accessed_ms, 0))) / 86400000.0::double) / 30.0::double), 9) DESC, created_at_ms DESC, item_id DESC) <= 50"""
)
def memory_merge(spark, sf_dir):
    return memory.merged(items(spark, sf_dir), catalog.CLOCK_MS, 30.0, 50).select("principal", "item_id", "salience", "said")


@query(f"WITH {_ITEMS} SELECT principal, count(*) AS kept FROM items WHERE NOT (principal = 3 AND created_at_ms < 1704067200000 - 10 * 86400000) GROUP BY 1")
def memory_forget(spark, sf_dir):
    rows = memory.forgotten(items(spark, sf_dir), {"principal": 3, "before_ms": catalog.CLOCK_MS - 10 * catalog.DAY_MS, "session_id": None})
    return rows.groupBy("principal").agg(F.count(F.lit(1)).alias("kept"))


@query(
    f"""WITH {_ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM items),
o AS (SELECT session_id, left(string_agg(({base.sentences("text")})[1], ' ' ORDER BY turn), 1000) AS summary FROM b WHERE back > 2 GROUP BY 1),
d AS (SELECT session_id, count(*) AS n FROM b WHERE role = 'user' AND regexp_matches(text, '(?i){memory.DECISION.replace("'", "''")}') GROUP BY 1)
SELECT coalesce(o.session_id, d.session_id) AS session_id, summary, coalesce(n, 0) AS decisions FROM o FULL JOIN d ON o.session_id = d.session_id"""
)
def memory_summary(spark, sf_dir):
    return memory.summaries(items(spark, sf_dir), 2).select("session_id", "summary", F.size("decisions").cast("long").alias("decisions"))


@query(f"WITH {_ITEMS} SELECT session_id, count(*) AS turns, min(created_at_ms) AS first_ms, max(created_at_ms) AS last_ms FROM items WHERE created_at_ms >= 1704067200000 - 20 * 86400000 GROUP BY 1")
def memory_turn_counts(spark, sf_dir):
    return memory.turn_counts(items(spark, sf_dir), catalog.CLOCK_MS, 20 * catalog.DAY_MS)
