"""Search over cells against scoring every pair."""

import numpy as np
import pytest

from querent.operators import retrieval, vector_index

POINT, QUERY = "point_id long, tenant_id string, acl_hash string, vector array<double>", "query_id long, tenant_id string, acl_hashes array<string>, query_vector array<double>"


def data(spark, seed, n, spread, dim=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dim))
    vector = lambda: (middles[rng.integers(12)] + spread * rng.normal(size=dim)).tolist()
    points = [(i, f"t{i % 2}", ["public", "a", "b"][i % 3], vector()) for i in range(n)]
    points += [(n + 1, "t0", "public", [0.0] * dim), (n + 2, "t0", "public", points[0][3]), (n + 3, "t0", "public", points[0][3])]
    queries = [(q, f"t{q % 2}", [["a"], []][q % 2], vector()) for q in range(10)] + [(50, "t0", [], [0.0] * dim), (51, "t9", [], vector()), (52, "t0", [], points[0][3])]
    return spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)


def rows(df):
    return sorted((r.query_id, r["rank"], r.point_id, round(r.score + 0.0, 6)) for r in df.collect())


@pytest.mark.parametrize("seed,n,spread,k", [(1, 300, 0.05, 5), (2, 300, 1.0, 10), (3, 20, 0.3, 50)])
def test_same_rows_as_all_pairs(spark, seed, n, spread, k):
    points, queries = data(spark, seed, n, spread)
    assert rows(vector_index.search(vector_index.built(points), queries, k)) == rows(retrieval.vector_search(queries, points, k))


def test_bounds_rule_most_points_out(spark, monkeypatch):
    points, queries = data(spark, 4, 2000, 0.05)
    queries = queries.where("query_id < 10")
    seen, scores = [], vector_index._scores
    monkeypatch.setattr(vector_index, "_scores", lambda *a: seen.append(scores(*a)) or seen[-1])
    vector_index.search(vector_index.built(points, 40), queries, 5).collect()
    assert 4 * sum(s.count() for s in seen) < queries.join(points, "tenant_id").count()


def test_nulls_and_empty(spark):
    points, queries = data(spark, 5, 10, 0.1)
    null = spark.createDataFrame([(99, "t0", "public", None)], POINT)
    cells = vector_index.built(points.unionByName(null))
    assert 99 not in {r.point_id for r in vector_index.search(cells, queries, 50).collect()}
    assert vector_index.search(vector_index.built(points.limit(0)), queries).count() == 0
    assert vector_index.search(cells, queries.limit(0)).count() == 0
    only = vector_index.built(points.where("point_id = 11"))  # zero vectors alone
    assert {r.score for r in vector_index.search(only, queries.where("tenant_id = 't0'")).collect()} == {0.0}
