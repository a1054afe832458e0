"""Top-k by blocks of chunks against scoring all pairs."""

import pytest
from pyspark.sql import functions as F

from querent.operators import blocks, retrieval
from tests.test_bounded import CHUNK, QUERY, data, rows


def tops(queries, chunks, k):
    by = blocks.asked(queries)
    found = blocks.tops((by, blocks.chunks_counted(chunks, by.terms)), k, retrieval.K1, retrieval.B)
    return [retrieval.top_k(found.where(f"leg = '{leg}'").drop("leg"), k) for leg in ("lexical", "overlap")]


@pytest.mark.parametrize("seed,cells,k", [(1, 4_000_000, 5), (2, 1, 3), (3, 200, 24), (4, 60, 1)])
def test_same_rows_as_all_pairs(spark, monkeypatch, seed, cells, k):
    monkeypatch.setattr(blocks, "CELLS", cells)
    queries, chunks = data(spark, seed)
    chunks = chunks.where("text is not null")
    lexical, overlap = tops(queries, chunks, k)
    held = retrieval.postings(queries, chunks)
    assert rows(lexical) == rows(retrieval.top_k(retrieval.bm25(queries, chunks, held=held), k))
    assert rows(overlap) == rows(retrieval.top_k(retrieval.overlap_leg(queries, chunks, held=held), k))


def test_few_rows_leave_the_texts_and_the_blocks(spark):
    queries, chunks = data(spark, 5, 1500)
    by = blocks.asked(queries)
    held = blocks.chunks_counted(chunks.repartition(2), by.terms)
    assert held.count() == chunks.count()  # a row for each chunk; postings were dealt out before
    n, _, mean, df = blocks.statistics(held, len(by.terms))
    assert 3 * blocks.best(held, by, n, mean, df, 3, retrieval.K1, retrieval.B).count() < retrieval.bm25(queries, chunks).count()


def test_copies_do_not_add_up(spark):
    chunks = spark.createDataFrame([(i, "t", "public", "one two") for i in range(500, 0, -1)] + [(0, "t", "public", "two")], CHUNK).coalesce(1)
    queries = spark.createDataFrame([(7, "one", "t", []), (8, "two", "u", [])], QUERY)
    by = blocks.asked(queries)
    held = blocks.chunks_counted(chunks, by.terms)
    n, _, mean, df = blocks.statistics(held, len(by.terms))
    assert blocks.best(held, by, n, mean, df, 4, retrieval.K1, retrieval.B).count() <= 8 * held.rdd.getNumPartitions()
    assert [(q, r, c) for q, r, c, _ in rows(tops(queries, chunks, 4)[0])] == [(7, k, k + 1) for k in range(4)]


def test_null_text_counts_as_a_chunk(spark):
    """As in SQL: count(*) has it, avg(len(words)) does not."""
    chunks = spark.createDataFrame([(1, "t", "public", "a b"), (2, "t", "public", None), (3, "t", None, "a"), (4, None, "public", "a")], CHUNK)
    held = blocks.chunks_counted(chunks, ["a"])
    n, ids, mean, df = blocks.statistics(held, 1)
    assert (n, ids, df.tolist()) == (4, 4, [3]) and abs(mean - 4 / 3) < 1e-12
    assert [c for _, _, c, _ in rows(tops(spark.createDataFrame([(1, "a", "t", None), (2, "a", "t", [])], QUERY), chunks, 3)[0])] == [1]


def test_what_cannot_be_sent_is_left_to_the_other_ways(spark, monkeypatch):
    queries, chunks = data(spark, 6, 20)
    assert blocks.asked(queries.unionByName(queries.limit(1))) is None
    by = blocks.asked(queries)
    assert blocks.tops((by, blocks.chunks_counted(chunks.unionByName(chunks.limit(1)), by.terms)), 3, 1.2, 0.75) is None
    empty = blocks.chunks_counted(chunks.limit(0), by.terms)
    assert blocks.tops((by, empty), 3, 1.2, 0.75).count() == 0
    none = blocks.asked(queries.limit(0))
    assert blocks.tops((none, blocks.chunks_counted(chunks, none.terms)), 3, 1.2, 0.75).count() == 0
    monkeypatch.setattr(blocks, "MOST_ASKED", 3)
    assert blocks.asked(queries) is None


def test_items_meet_documents_by_words_that_are_counted_already(spark):
    docs = spark.createDataFrame([(1, "say alpha betamax now"), (2, "ALPHA beta gamma, delta"), (3, "one"), (4, None), (5, "x one two three y")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha beta"), (11, "one two three"), (12, "beta gamma, d"), (13, "nowhere at all here")], "query_id long, item string")
    terms = "alpha at all beta d gamma here nowhere one three two".split()
    held = terms, blocks.counted(docs.select("doc_id", F.lower("text").alias("low")), terms)
    assert sorted(map(tuple, retrieval.holders(items, docs.where("doc_id <> 2"), held).collect())) == [(10, 1), (11, 5)]  # doc 2 has no text to compare with
    assert sorted(map(tuple, retrieval.holders(items, docs, held).collect())) == sorted(map(tuple, retrieval.holders(items, docs).collect())) == [(10, 1), (11, 5), (12, 2)]
