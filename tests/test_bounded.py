"""Top-k by bounds against scoring all pairs."""

import random

import pytest

from querent.operators import bounded, retrieval

CHUNK = "chunk_id long, tenant_id string, acl_hash string, text string"
QUERY = "query_id long, query_text string, tenant_id string, acl_hashes array<string>"


def data(spark, seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "and", "in"] + [f"w{i}" for i in range(30)]
    weight = [40, 30, 20, 15] + [1] * 30
    body = lambda m: " ".join(rng.choices(words, weight, k=m))
    docs = [(i, f"t{i % 2}", rng.choice(["public", "a", "b"]), body(rng.randrange(1, 60))) for i in range(n)] + [(900, "t0", "public", None), (901, "t1", "public", ""), (902, "t0", "public", body(4000))]
    asked = [(q, body(rng.randrange(1, 14)), f"t{q % 2}", [["a"], [], ["b", "a"]][q % 3]) for q in range(12)]
    asked += [(50, "the", "t0", ["a"]), (51, "the of", "t1", []), (52, "w3", "t0", []), (53, "nothing", "t0", []), (54, "", "t1", []), (55, None, "t1", []), (56, "the the w1", "t3", ["a"])]
    return spark.createDataFrame(asked, QUERY), spark.createDataFrame(docs, CHUNK)


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("seed,bits,k", [(1, 64, 5), (2, 2, 3), (3, 4, 24), (4, 0, 5)])
def test_same_rows_as_all_pairs(spark, monkeypatch, seed, bits, k):
    monkeypatch.setattr(bounded, "BITS", bits)
    queries, chunks = data(spark, seed)
    held = retrieval.postings(queries, chunks)
    pool = bounded.pool(queries, bounded.rows_of(held))
    assert rows(bounded.bm25_top(pool, k)) == rows(retrieval.top_k(retrieval.bm25(queries, chunks, held=held), k))
    assert rows(bounded.overlap_top(pool, k)) == rows(retrieval.top_k(retrieval.overlap_leg(queries, chunks, held=held), k))


def test_few_pairs_are_scored_in_full(spark, monkeypatch):
    monkeypatch.setattr(bounded, "BITS", 4)
    queries, chunks = data(spark, 5, 1500)
    queries = queries.where("query_id < 12 and length(query_text) > 20")
    held = retrieval.postings(queries, chunks)
    pool = bounded.pool(queries, bounded.rows_of(held))
    assert 3 * bounded.bm25_candidates(pool, 3).count() < retrieval.bm25(queries, chunks, held=held).count()


def test_empty(spark):
    queries, chunks = data(spark, 6, 5)
    for q, c in ((queries.limit(0), chunks), (queries, chunks.limit(0))):
        pool = bounded.pool(q, bounded.rows_of(retrieval.postings(q, c)))
        assert bounded.bm25_top(pool).count() == 0 and bounded.overlap_top(pool).count() == 0
