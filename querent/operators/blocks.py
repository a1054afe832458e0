"""Exact top-k lexical search by blocks of chunks, for a query set that is counted small enough to be sent to every task.

One pass over the texts counts the query terms of each chunk where it is: a row for each chunk is stored, and neither words
nor postings are dealt out. A second pass scores blocks of these rows against the queries that may see them, both rankings at
once. Each task keeps the k-th best score of every query so far, and passes on only what reaches it; so what leaves a block
is a few rows of each query, whatever terms are common. The rows are those of scoring all pairs.

Scores are rounded to six places after that, so what is EDGE below the k-th is passed on too. Of equal scores of a block only
the k least ids are, so that copies do not add up. Chunks of null text count as chunks, without a length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions import text
from querent.sources.shared import cut, spread

#: Rows of queries and terms, and different terms, that may be sent to every task, both counted.
MOST_ASKED, MOST_TERMS = 1_000_000, 500_000
#: Cells of a block's table of rows and queries, or of its postings and queries; texts that are counted at once.
CELLS, TEXTS = 4_000_000, 1000
EDGE = 2e-6

_COUNTS = "length int, n_words int, terms array<int>, tfs array<int>"


@dataclass(frozen=True)
class Asked:
    """A query set by number: its terms in order, and of each query and term (by their numbers) how often it is asked."""

    terms: list
    ids: pa.Array
    kind: str  # of the ids
    scopes: list  # of each query: tenant and labels that it may see
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray


def asked(queries: DataFrame) -> Asked | None:
    """The query set, or None where it is too large to be sent or has two queries of one id."""
    if not queries.groupBy("query_id").count().where("count > 1").isEmpty():
        return None
    rows = queries.select("query_id", "tenant_id", "acl_hashes", F.explode(text.tokens(F.col("query_text"))).alias("term"))
    rows = cut(rows.groupBy("query_id", "tenant_id", "acl_hashes", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    if rows.count() > MOST_ASKED:
        return None
    kind = rows.schema["query_id"].dataType.simpleString()
    rows = rows.orderBy("query_id", "term").toArrow()
    names = pc.unique(rows["query_id"])
    first = dict(zip(rows["query_id"].to_pylist(), zip(rows["tenant_id"].to_pylist(), rows["acl_hashes"].to_pylist())))
    terms = sorted(set(rows["term"].to_pylist()))
    if len(terms) > MOST_TERMS:
        return None
    number = {t: k for k, t in enumerate(terms)}
    query = pc.index_in(rows["query_id"], value_set=names).to_numpy().astype(np.int64)
    term = np.array([number[t] for t in rows["term"].to_pylist()], np.int64)
    return Asked(terms, names, kind, [first[q] for q in names.to_pylist()], query, term, rows["times"].to_numpy().astype(np.int64))


def counted(rows: DataFrame, terms: list[str], tag: str = "counted") -> DataFrame:
    """Stored rows with their lower-cased text (column `low`) replaced by its length in tokens, its distinct tokens, and of the
    terms in it, by their number in the list, the counts."""
    names = [c for c in rows.columns if c != "low"]
    sent = rows.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches):
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            made = _counts(batch.column(batch.schema.get_field_index("low")).to_pylist(), sent.value)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "length", "n_words", "terms", "tfs"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return cut(spread(rows).mapInArrow(run, f"{kinds}, {_COUNTS}"), tag)


def _counts(texts: list, number: dict) -> list[pa.Array]:
    find, get = re.compile(text.LEXICAL).findall, number.get
    length, distinct, of, sizes = [], [], [], []
    for t in texts:
        words = [] if t is None else find(t)
        length.append(None if t is None else len(words))
        distinct.append(None if t is None else len(set(words)))
        before = len(of)
        of.extend(k for k in map(get, words) if k is not None)
        sizes.append(len(of) - before)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    pairs, tf = np.unique(row * max(len(number), 1) + np.array(of, np.int64), return_counts=True)
    row, term = np.divmod(pairs, max(len(number), 1))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (term, tf)]
    return [pa.array(length, pa.int32()), pa.array(distinct, pa.int32()), *lists]


def chunks_counted(chunks: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    return counted(chunks.select("chunk_id", F.col("tenant_id").alias("owner"), "acl_hash", F.lower(text_col).alias("low")), terms)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, float, np.ndarray]:
    """The chunks, their different ids, their mean length in tokens and how many of them have each term."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.avg("length").alias("mean_length")).first()
    found = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # MOST_TERMS at most
    df = np.zeros(n_terms, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return s.n, s.ids, s.mean_length or 0.0, df


def best(rows: DataFrame, by: Asked, n: int, mean_length: float, df: np.ndarray, k: int, k1: float, b: float, legs: tuple = ("lexical", "overlap")) -> DataFrame:
    """Stored rows of leg ('lexical' or 'overlap'), query_id, chunk_id and score: those of the k best chunks of each query by
    these rankings, and some more. `rows`: chunk_id, owner, acl_hash, length, n_words, terms and tfs, a row for each chunk."""
    weight = by.times * np.log(1 + (n - df[by.term] + 0.5) / (df[by.term] + 0.5))
    sent = rows.sparkSession.sparkContext.broadcast((by, weight))

    def run(batches):
        by, weight = sent.value
        scopes, least = _Scopes(by, weight), np.zeros((2, len(by.ids)))
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            for leg, query, row, score in _scored(batch.num_rows, col, scopes, least, mean_length, k, k1, b, legs):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array([leg] * len(row)), by.ids.take(pa.array(query)), col("chunk_id").take(pa.array(row)), pa.array(score)], ["leg", "query_id", "chunk_id", "score"])

    return cut(rows.mapInArrow(run, f"leg string, query_id {by.kind}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double"), "best")


class _Scopes:
    """For an owner and a label the queries that may see such chunks, and their terms in order."""

    def __init__(self, by: Asked, weight: np.ndarray):
        self.by, self.weight, self.known, self.tenants = by, weight, {}, {}
        self.n_asked = np.bincount(by.query, minlength=len(by.ids))
        for q, (tenant, labels) in enumerate(by.scopes):
            if tenant is not None and labels is not None:
                self.tenants.setdefault(tenant, []).append((q, {*labels, "public"}))

    def of(self, owner, label):
        if (owner, label) not in self.known:
            seeing = np.array([q for q, labels in self.tenants.get(owner, []) if label is not None and label in labels], np.int64)
            place = np.full(len(self.by.ids), -1)
            place[seeing] = np.arange(len(seeing))
            mine = np.flatnonzero(place[self.by.query] >= 0)
            mine = mine[np.argsort(self.by.term[mine], kind="stable")]
            terms, starts, counts = np.unique(self.by.term[mine], return_index=True, return_counts=True)
            self.known[owner, label] = seeing, terms, starts, counts, place[self.by.query[mine]], self.weight[mine]
        return self.known[owner, label]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _scored(n_rows, col, scopes, least, mean_length, k, k1, b, legs):
    ends = col("terms").offsets.to_numpy().astype(np.int64)
    term, tf = col("terms").values.to_numpy().astype(np.int64), col("tfs").values.to_numpy().astype(np.float64)
    first, size = ends[:-1], np.diff(ends)
    n_words = pc.fill_null(col("n_words"), 0).to_numpy().astype(np.int64)
    norm = k1 * (1 - b + b * pc.fill_null(col("length"), 0).to_numpy() / (mean_length or 1.0))
    place = np.empty(n_rows, np.int64)
    place[pc.sort_indices(col("chunk_id"), null_placement="at_start").to_numpy()] = np.arange(n_rows)
    owner, label = (col(c).dictionary_encode() for c in ("owner", "acl_hash"))
    codes = [pc.fill_null(x.indices, -1).to_numpy().astype(np.int64) for x in (owner, label)]
    kinds = codes[0] * (len(label.dictionary) + 2) + codes[1]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        names = [x.dictionary[int(c[rows[0]])].as_py() if c[rows[0]] >= 0 else None for x, c in zip((owner, label), codes)]
        seeing, terms, starts, counts, at_query, weight = scopes.of(*names)
        if not len(terms):
            continue
        step = max(1, CELLS // max(len(at_query), len(seeing)))
        for s in range(0, len(rows), step):
            of = rows[s : s + step]
            p, row = _runs(first[of], size[of]), np.repeat(np.arange(len(of)), size[of])
            at = np.minimum(np.searchsorted(terms, term[p]), len(terms) - 1)
            hit = terms[at] == term[p]
            p, row, at = p[hit], row[hit], at[hit]
            e, cell = _runs(starts[at], counts[at]), np.repeat(row * len(seeing), counts[at])
            cell = cell + at_query[e]
            gain = tf[p] * (k1 + 1) / (tf[p] + norm[of][row])
            shape = (len(of), len(seeing))
            score = np.bincount(cell, weight[e] * np.repeat(gain, counts[at]), len(of) * len(seeing)).reshape(shape)
            both = np.bincount(cell, minlength=len(of) * len(seeing)).reshape(shape)
            share = both / (scopes.n_asked[seeing][None, :] + n_words[of][:, None] - both)
            for leg, (name, m) in enumerate((("lexical", score), ("overlap", share))):
                if name not in legs:
                    continue
                if len(of) >= k:
                    least[leg][seeing] = np.maximum(least[leg][seeing], np.partition(m, len(of) - k, axis=0)[len(of) - k])
                r, c = np.nonzero((m > 0) & (m >= least[leg][seeing] - EDGE))
                value = m[r, c]
                order = np.lexsort((place[of[r]], -value, c))
                r, c, value = r[order], c[order], value[order]
                if len(r):
                    new = np.concatenate([[True], (np.diff(c) != 0) | (np.diff(value) != 0)])
                    among = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
                    r, c, value = r[among < k], c[among < k], value[among < k]
                yield name, seeing[c], of[r], value


def tops(held: tuple[Asked, DataFrame], k: int, k1: float, b: float) -> DataFrame | None:
    """The candidates of both rankings (leg, query_id, chunk_id, score), or None where a chunk_id is null or repeated. `held`: a
    query set and chunks_counted() of its terms."""
    by, rows = held
    n, ids, mean_length, df = statistics(rows, len(by.terms))
    if n != ids:
        return None
    found = best(rows, by, n, mean_length, df, k, k1, b)
    return found.withColumn("score", F.round("score", 6)).where("leg = 'overlap' or score > 0")
