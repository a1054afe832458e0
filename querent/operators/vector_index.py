"""Exact vector search over cells, pruned by distance bounds.

Points become unit vectors and belong to the nearest of some centres, points of the table themselves, CENTRES at most. The
stored table has each point's cell and its distance from the centre; the centres and the radius of each cell are a
small array. A query first visits its FIRST nearest cells; the k-th best score there bounds the distance that a better point
can have. By the triangle inequality a cell that is further than its radius and that bound holds none, nor does a point whose
distance from its centre differs from the query's by more. The cells that are left are visited, so results are exact: pairs
meet by tenant and cell, and scores are taken only of points that both bounds let through.

Null vectors are in no cell and never found; zero vectors have cosine 0 with all, and lie in a cell of their own that is always
visited; a zero query visits every cell. Fewer than k visible points give fewer rows. Ties go to the smaller id, repeated ids are
rows of their own. All vectors have one length. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.sources.shared import cut, spread

#: Centres at most, and cells that each query visits first. The driver holds the centres: 1024 x 64 doubles are half a MB.
CENTRES, FIRST = 1024, 4
#: Rounding of scores (six places), as a distance: bounds give way by so much.
EDGE = 2e-3
#: The cell of zero vectors.
ZERO = -1


@dataclass(frozen=True)
class Cells:
    points: DataFrame  # tenant_id, acl_hash, point_id, cell, away, unit
    centres: np.ndarray
    radius: np.ndarray


def _unit(vectors: list) -> np.ndarray:
    v = np.asarray(vectors, float).reshape(len(vectors), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def built(points: DataFrame, centres: int | None = None) -> Cells:
    """Cells of points (point_id, tenant_id, acl_hash, vector). Without a number, about the square root of the points' number."""
    points = points.where("vector is not null").select("tenant_id", "acl_hash", "point_id", F.col("vector").cast("array<double>").alias("vector"))
    n = min(CENTRES, centres or max(1, int(points.count() ** 0.5)))
    some = points.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("point_id"), "point_id").select("vector").limit(n).collect()  # CENTRES at most
    middle = _unit([r.vector for r in some]) if some else np.zeros((0, 1))
    kind = points.schema["point_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(3).to_pylist())
            cell, away = np.full(len(unit), ZERO, np.int32), np.zeros(len(unit))
            if len(middle):
                d = _distances(unit, middle)
                cell, away = d.argmin(axis=1).astype(np.int32), d.min(axis=1)
                cell[~unit.any(axis=1)] = ZERO
            columns = [*batch.columns[:3], pa.array(cell), pa.array(away), pa.array(list(unit), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["tenant_id", "acl_hash", "point_id", "cell", "away", "unit"])

    rows = cut(spread(points).mapInArrow(run, f"tenant_id string, acl_hash string, point_id {kind}, cell int, away double, unit array<double>"), "cells")
    radius = np.zeros(len(middle))
    for r in rows.where(F.col("cell") >= 0).groupBy("cell").agg(F.max("away").alias("r")).collect():  # CENTRES at most
        radius[r.cell] = r.r
    return Cells(rows, middle, radius)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors: from cosines, so that equal ones are at 0 but for rounding."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _visits(cells: Cells, queries: DataFrame, first: int | None) -> DataFrame:
    """Rows of query and cell: the `first` nearest ones; or, with `reach` of each query, those that its bound can't rule out,
    without these. distance is null where no point can be ruled out."""
    kind = queries.schema["query_id"].dataType.simpleString()
    middle, radius, least = cells.centres, cells.radius, FIRST

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(unit := _unit(batch.column(1).to_pylist()), middle) if len(middle) else np.zeros((batch.num_rows, 0))
            unit = unit if len(middle) else _unit(batch.column(1).to_pylist())
            rows, at, far = [], [], []
            for k in range(len(d)):
                near = np.argsort(d[k], kind="stable")
                if first is not None:
                    chosen = near[:first]
                else:
                    reach = batch.column(2)[k].as_py()
                    rest = near[least:]
                    chosen = rest if reach is None or not unit[k].any() else rest[d[k][rest] <= radius[rest] + reach]
                found = [*chosen.tolist(), *([ZERO] if first is not None else [])]
                rows += [k] * len(found)
                at += found
                far += [None if c == ZERO or not unit[k].any() else float(d[k][c]) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(far, pa.float64())], names=["query_id", "cell", "distance"])

    names = ["query_id", "query_vector", *([] if first is not None else ["reach"])]
    return queries.select(*names).mapInArrow(run, f"query_id {kind}, cell int, distance double")


@F.pandas_udf(T.DoubleType())
def _dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", np.stack(a), np.stack(b)) if len(a) else [])


def _scores(cells: Cells, queries: DataFrame, visits: DataFrame, reach: bool) -> DataFrame:
    """Scores of the points of visited cells that the query may see and the bound lets through."""
    asked = queries.select("query_id", "tenant_id", "acl_hashes", "query_unit", *(["reach"] if reach else []))
    met = visits.join(asked, "query_id").join(cells.points, ["tenant_id", "cell"]).where(F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash")))
    if reach:
        met = met.where(F.col("reach").isNull() | F.col("distance").isNull() | (F.abs(F.col("distance") - F.col("away")) <= F.col("reach")))
    return met.select("query_id", "point_id", F.round(_dot("query_unit", "unit"), 6).alias("score"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _units(vectors: pd.Series) -> pd.Series:
    return pd.Series(list(_unit(vectors.tolist())) if len(vectors) else [])


def search(cells: Cells, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, point_id, score and rank (from 0) of the k best points of each query (query_id, tenant_id, acl_hashes, query_vector)."""
    queries = queries.where("query_vector is not null").withColumn("query_vector", F.col("query_vector").cast("array<double>"))
    queries = cut(queries.withColumn("query_unit", _units("query_vector")), "asked")
    near = cut(_scores(cells, queries, _visits(cells, queries, FIRST), False), "near")
    # cosine s is distance sqrt(2 - 2 s)
    reach = _best(near, k).where(F.col("rank") == k - 1).select("query_id", (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) + EDGE).alias("reach"))
    queries = cut(queries.join(reach, "query_id", "left"), "reach")
    return _best(near.unionByName(_scores(cells, queries, _visits(cells, queries, None), True)), k)
