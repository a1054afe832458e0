"""The tables, and the fixed derivation of the engine's fields from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import text

#: The as-of clock in milliseconds; nothing reads the wall clock.
CLOCK_MS = 1704067200000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tenant, access label, authority and time of update."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("source_id"),
        F.concat(F.lit("tenant-"), (d % 3).cast("string")).alias("tenant_id"),
        F.when(d % 5 == 0, "acl-finance").when(d % 5 == 1, "acl-eng").otherwise("public").alias("acl_hash"),
        F.round(F.lit(0.3) + F.lit(0.1) * (d % 7), 6).alias("authority"),
        F.when(d % 2 == 0, F.lit(CLOCK_MS) - d * DAY_MS).otherwise(F.lit(0)).cast("long").alias("updated_at_ms"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: each benchmark item, its white space collapsed, and who asks."""
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.array_join(words, " ").alias("query_text"),
        F.concat(F.lit("tenant-"), (F.col("item_id") % 3).cast("string")).alias("tenant_id"),
        F.array(F.lit("acl-eng")).alias("acl_hashes"),
    )


def visible(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Query and chunk rows where the principal may see the chunk: its tenant, and an access label that it holds or `public`."""
    open_to = F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash"))
    return queries.join(chunks, "tenant_id").where(open_to)


def query_tokens(queries: DataFrame) -> DataFrame:
    """One row for each query token, repeats kept."""
    return queries.select("query_id", "tenant_id", "acl_hashes", F.explode(text.tokens(F.col("query_text"))).alias("term"))


#: The same derivations in SQL, as common table expressions.
SQL_DOCUMENTS = """docs AS (SELECT doc_id, text, lang, source AS source_id, concat('tenant-', doc_id % 3) AS tenant_id,
  CASE doc_id % 5 WHEN 0 THEN 'acl-finance' WHEN 1 THEN 'acl-eng' ELSE 'public' END AS acl_hash,
  round(0.3::double + 0.1::double * (doc_id % 7), 6) AS authority,
  CASE WHEN doc_id % 2 = 0 THEN 1704067200000 - doc_id * 86400000 ELSE 0 END AS updated_at_ms FROM documents)"""
SQL_QUERIES = """queries AS (SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ') AS query_text,
  concat('tenant-', item_id % 3) AS tenant_id FROM benchmark)"""
