"""Queries over normalisation, chunking and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.operators import ingestion
from querent.sources import catalog

from . import base
from .base import query

_MARKED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, chr(10), chr(10) || chr(10) || '# Part' || chr(10), 'g') WHEN doc_id % 3 = 1 THEN regexp_replace(text, chr(10), chr(10) || chr(10) || 'section 4.2 says' || chr(10), 'g') ELSE text END AS text FROM documents"


def marked(spark, sf_dir):
    """Documents with headings or clauses put between their lines, as the tables hold neither."""
    n = F.col("doc_id") % 3
    made = F.when(n == 0, F.replace("text", F.lit("\n"), F.lit("\n\n# Part\n"))).when(n == 1, F.replace("text", F.lit("\n"), F.lit("\n\nsection 4.2 says\n"))).otherwise(F.col("text"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


_TEXT = f"""WITH m AS ({_MARKED}), p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM m),
b AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS block_no FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*(?:\\[[\\d:.\\s]+\\]\\s*)?([A-Z][\\w .''-]{{1,40}}):\\s+\\S') THEN 'speaker_turn' WHEN regexp_matches(text, '^\\s*(?:section|article|clause)?\\s*\\d+(?:\\.\\d+)*\\.?\\s+\\S') THEN 'clause' ELSE 'paragraph' END AS kind FROM b)
"""


@query(_TEXT + "SELECT doc_id, block_no, kind, sha256(text) AS text_sha256 FROM k")
def normalize_text_blocks(spark, sf_dir):
    return ingestion.text_blocks(marked(spark, sf_dir)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "kind", F.sha2("text", 256).alias("text_sha256"))


_MD = f"""WITH m AS ({_MARKED}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM m),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.*$') THEN 'heading' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table_header' WHEN regexp_matches(line, '^\\s*>') THEN 'quote'
  WHEN regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+.*$') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
g AS (SELECT *, CASE WHEN kind = 'paragraph' THEN 'p' || sum((kind <> 'paragraph')::int) OVER (PARTITION BY doc_id ORDER BY n) ELSE 'l' || n END AS grp FROM k),
b AS (SELECT doc_id, kind, min(n) AS n, string_agg(trim(CASE WHEN kind = 'heading' THEN regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1) WHEN kind = 'quote' THEN regexp_extract(line, '^\\s*>\\s?(.*)$', 1) WHEN kind = 'list_item' THEN regexp_extract(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.*)$', 1) ELSE line END), ' ' ORDER BY n) AS text FROM g WHERE kind <> 'blank' GROUP BY doc_id, kind, grp),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_no, CASE WHEN kind = 'paragraph' AND regexp_matches(text, '^\\s*(?:section|article|clause)?\\s*\\d+(?:\\.\\d+)*\\.?\\s+\\S') THEN 'clause' ELSE kind END AS kind, text FROM b),
dt AS (SELECT d.doc_id, count(r.kind) AS blocks, count_if(kind = 'heading') AS headings, CASE WHEN count(r.kind) = 0 THEN 'degraded' WHEN count_if(kind = 'clause')::double / count(*) >= 0.30 THEN 'legal_or_policy' WHEN count_if(kind = 'table_header')::double / count(*) >= 0.50 THEN 'tabular'
  WHEN count_if(kind = 'heading') >= 2 THEN 'structured_prose' ELSE 'unstructured_prose' END AS doc_type FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1)
"""


@query(_MD + "SELECT doc_id, block_no, kind, length(text) AS chars FROM r")
def markdown_blocks(spark, sf_dir):
    return ingestion.markdown_blocks(marked(spark, sf_dir)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "kind", F.length("text").cast("long").alias("chars"))


def typed(spark, sf_dir):
    docs = marked(spark, sf_dir)
    return ingestion.document_types(docs, ingestion.markdown_blocks(docs))


@query(_MD + "SELECT doc_id, doc_type, blocks, headings FROM dt")
def doc_type(spark, sf_dir):
    return typed(spark, sf_dir)


@query(_MD + "SELECT doc_type, CASE WHEN doc_type = 'structured_prose' AND headings >= 2 THEN 'structure_aware' ELSE 'recursive_character' END AS strategy, count(*) AS n FROM dt GROUP BY ALL")
def chunk_strategy(spark, sf_dir):
    rows = typed(spark, sf_dir)
    return rows.groupBy("doc_type", ingestion.chunk_strategy(F.col("doc_type"), F.col("headings")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS t FROM documents), r AS (SELECT source, CASE WHEN t = '' THEN 'empty' WHEN {base.token_estimate("t")} < 12 THEN 'too_short'
  WHEN regexp_matches(t, '(?i)^\\s*(page\\s+\\d+(\\s+of\\s+\\d+)?|figure\\s+\\d+|table\\s+\\d+|\\d+|[-_=*.|\\s\\x{{2013}}\\x{{2014}}\\x{{2022}}\\x{{b7}}]+)\\s*$') THEN 'boilerplate' END AS reason FROM l)
SELECT source, count(*) AS chunks, count(reason) AS rejected, round(count(reason)::double / count(*), 6) AS rejection_rate, round(count(reason)::double / count(*), 6) > 0.30 AS suspect FROM r GROUP BY 1"""
)
def chunk_rejection_rate(spark, sf_dir):
    lines = catalog.table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("t")).withColumn("t", F.trim("t"))
    rate = F.round(F.count("reason") / F.count(F.lit(1)), 6)
    return lines.select("source", ingestion.rejection(F.col("t")).alias("reason")).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count("reason").alias("rejected"), rate.alias("rejection_rate"), (rate > 0.30).alias("suspect"))


@query()
def normalize_html(spark, sf_dir):
    """An HTML parser is beyond SQL; tests hold hand-made pages."""
    pages = catalog.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return ingestion.html_blocks(pages)


@query()
def chunk_structure(spark, sf_dir):
    """Greedy packing is beyond SQL; tests hold invariants and hand-made documents."""
    docs = marked(spark, sf_dir)
    blocks = ingestion.markdown_blocks(docs)
    kinds = ingestion.document_types(docs, blocks).where(ingestion.chunk_strategy(F.col("doc_type"), F.col("headings")) == "structure_aware").select("doc_id")
    return ingestion.structure_chunks(blocks.join(kinds, "doc_id", "left_semi"))


@query()
def chunk_recursive(spark, sf_dir):
    """Recursive cutting is beyond SQL; tests hold invariants."""
    return ingestion.recursive_chunks(catalog.table(spark, sf_dir, "documents"))


@query()
def hashed_embeddings(spark, sf_dir):
    """BLAKE2b has no SQL twin; tests hold the brute force."""
    return ingestion.hashed_vectors(catalog.table(spark, sf_dir, "documents"))


@query(f"WITH {catalog.SQL_DOCUMENTS} SELECT doc_id::varchar AS chunk_id, tenant_id, acl_hash, authority, source_id, doc_id AS lineage_root, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END || chr(10) || chr(10) || text AS prefixed, 'slow' AS volatility FROM docs")
def index_payload(spark, sf_dir):
    docs = catalog.documents(spark, sf_dir)
    path = F.array(F.when(F.col("lang") == "en", "en").otherwise("other"))
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "tenant_id", "acl_hash", "authority", "source_id", F.coalesce(F.lit(None).cast("long"), "doc_id").alias("lineage_root"), ingestion.prefixed(F.col("text"), path).alias("prefixed"), F.lit("slow").alias("volatility"))


_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM documents)"""


@query(
    f"""WITH {_LINES}, q AS (SELECT doc_id, quality, toxic FROM labels), after AS (SELECT doc_id, k, CASE WHEN quality = 0 AND k = 1 THEN line || ' !' ELSE line END AS line FROM lines LEFT JOIN q USING (doc_id)
  WHERE coalesce(toxic, 0) = 0 AND NOT (coalesce(quality, 1) = 0 AND k = n AND n > 1) UNION ALL SELECT doc_id, n + 1, 'checked' FROM lines JOIN q USING (doc_id) WHERE quality = 1 AND toxic = 0 AND k = n)
SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.line = b.line THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n
FROM lines b FULL JOIN after a ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY 1"""
)
def index_changes(spark, sf_dir):
    """What an index has to do between two states of a corpus whose entries are lines: documents of low quality get
    another first line and lose their last, good ones get one more, toxic ones are gone."""
    docs = catalog.table(spark, sf_dir, "documents").join(catalog.table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = docs.select("doc_id", "quality", "toxic", F.split("text", "\n").alias("lines"))
    low, good = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False))
    worse = F.transform(F.when(F.size("lines") > 1, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines")), lambda line, k: F.when(k == 0, F.concat(line, F.lit(" !"))).otherwise(line))
    later = lines.where(F.coalesce("toxic", F.lit(0)) == 0).withColumn("lines", F.when(low, worse).when(good, F.array_append("lines", F.lit("checked"))).otherwise(F.col("lines")))

    def entries(rows):
        rows = rows.select("doc_id", F.posexplode("lines").alias("order", "text"))
        chunks = rows.select(F.concat_ws(":", "doc_id", "order").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "order", "text")
        return ingestion.entry_hash(ingestion.payload(chunks, "hash-1"))

    return ingestion.changes(entries(lines), entries(later), whole=True).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
