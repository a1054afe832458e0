"""The corpus pipeline: a table of documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and is written and read back before the next. All but
the last return the columns of docs, whatever further columns there are. Null text goes in the first stage, as do texts
without a letter; texts that lines are dropped from may become empty and stay. Decisions are taken for rows, told apart by
doc_id and text; null doc_ids match each other. An empty table gives no rows. Tables of the stages are kept in the shared
folder (spark.checkpoint.dir) until it is cleared, as the result is read from them.
"""

from __future__ import annotations

from querent.llm import jaccard, langid, lines, packing, secrets
from querent.llm.common import stored

#: Near duplicates of this stage: words of a shingle, and the least Jaccard index. op10's query has values of its own.
WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100


def language_id(spark, docs, sf_dir):
    """Documents without a recognisable language go: null texts and those without a letter. Where no language can be learnt
    (no label outside the held-out fold), every text with a letter stays."""
    return langid.accepted(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines of recurring templates go; their first document keeps them. Rows with null doc_id are left as they are."""
    return lines.line_deduplicated(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents (five-word shingles, Jaccard 0.8) stays, that of the smallest doc_id.
    Texts without words are linked with nothing. Rows of equal doc_id and text count as copies, so one of them stays."""
    return jaccard.one_of_each(docs, WIDTH, NUMERATOR, DENOMINATOR)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked; every document stays. Null text stays null."""
    return secrets.secrets_masked(docs)


def best_fit_packing(spark, docs, sf_dir):
    """A row for each piece of a document with its place in a sequence. Null text counts as empty: one piece, the separator."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: Learnt models, connected components and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
