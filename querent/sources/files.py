"""Readers of corpora and cases kept as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "case_id string, query string, tenant_id string, acl_hashes array<string>, relevant_document_ids array<string>, expected_facts array<string>, expect_abstain boolean, expected_outcome string, forbidden_strings array<string>, aspect_documents map<string, array<string>>, tags array<string>"


def markdown_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files under <tenant>/<access label>/<id>.md; tenant and label come from the path, never from the content."""
    path = F.col("_metadata.file_path")
    rows = spark.read.text(f"{folder}/*/*/*.md", wholetext=True).select(F.col("value").alias("text"), path.alias("path"))
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.md$", k)
    return rows.select(part(1).alias("tenant_id"), part(2).alias("acl_hash"), part(3).alias("document_id"), F.concat(F.lit("kb."), part(1)).alias("source_id"), "text")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases as lines of JSON; blank lines and comments are skipped, a line that isn't a case fails the read."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    rows = lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    return rows.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("tenant-local")))
