"""A persistent lexical index: postings kept by batches, statistics kept by deltas, merged on read, compacted in bulk.

A folder holds an index. Each batch of rows to add, replace or delete writes tables of its own, and a version (see
querent.sources.versions) that lists all tables which count, the number of documents and their tokens; so readers of an
older version are not disturbed, and what a failed writer left is never read.

* segments: one row for each chunk (chunk_id, owner, acl_hash, length, n_words) with its different terms, the empty one
  first, and how often each is there, both as one string with spaces between; bucketed and sorted by chunk_id. Words are
  counted where a text is read, so a batch sorts and writes a row for each chunk and not for each of its words, and marks
  meet chunks, not words. All terms of a chunk share a bucket, so no bucket is hot because a term is. Readers get a row for each chunk
  and term (live, postings), or chunks with the numbers of the terms asked for (counted), which blocks.best() scores
  without dealing out postings.
* marks: the chunk ids of each batch. A row of a segment is live if no later batch marks its chunk. Marks are sent to the
  segments if counted small, and otherwise dealt to the segments' own buckets: history is not shuffled either way.
* terms: changes of the document frequency of each term, bucketed by term.

A batch costs a pass over its own rows and, for the statistics of what it replaces, a semi join of its ids with the
segments' buckets. compact() writes all that is live as one segment; due() says when that pays: when the rows of batches
since then reach half of those of the first segment, so that each row is rewritten a bounded number of times. Rows of a
segment are counted by chunk and term for that.

Rows without a chunk_id are left out, but counted in `offered`. Of rows of one chunk_id in a batch the one of the greatest
`order` (an own column, where given), then text, counts. Null text has no tokens, and such a chunk counts as a document.
Deleting what is not there changes nothing. An index without documents finds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.sources import versions

#: Chunk ids that may be broadcast; more are dealt to the buckets.
SENT = 500_000
#: Query terms that may be broadcast.
TERMS = 500_000
#: Batches after which compaction is due whatever their size.
MOST_BATCHES = 16
#: Texts whose words are counted at once.
TEXTS = 1000
#: Terms of a task's chunks that are counted together before they are dealt out.
COUNTED = 4_000_000
#: How segments are laid out; an index of another layout is built anew.
LAYOUT = 2


@dataclass(frozen=True)
class Index:
    """An index as of one version."""

    spark: SparkSession
    folder: str
    version: int
    state: dict

    @property
    def documents(self) -> int:
        return self.state["documents"]

    @property
    def tokens(self) -> int:
        return self.state["tokens"]


def create(spark: SparkSession, folder: str, buckets: int | None = None, id_type: str = "bigint") -> Index:
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = {"layout": LAYOUT, "buckets": buckets, "id_type": id_type, "seq": 0, "documents": 0, "tokens": 0, "offered": 0, "segments": [], "marks": [], "terms": []}
    return Index(spark, folder, versions.commit(spark, folder, 0, state), state)


def reopened(spark: SparkSession, folder: str) -> Index:
    version, state = versions.latest(spark, folder)
    if not version:
        raise ValueError(f"no index in {folder}")
    if state.get("layout") != LAYOUT:
        raise ValueError(f"the index in {folder} has layout {state.get('layout', 1)}, not {LAYOUT}: build it anew")
    return Index(spark, folder, version, state)


def _shape(index: Index, kind: str) -> tuple[str, str, str]:
    """Columns, bucket column and sort column of a kind of table."""
    ids = f"chunk_id {index.state['id_type']}"
    return {
        "segment": (f"{ids}, owner string, acl_hash string, length int, n_words int, terms string, tfs string", "chunk_id", "chunk_id"),
        "marks": (ids, "chunk_id", "chunk_id"),
        "terms": ("term string, df bigint", "term", "term"),
    }[kind]


def _written(index: Index, rows: DataFrame, kind: str, dealt: bool = False) -> dict:
    """Writes a table, a file for each bucket. `dealt`: the rows are partitioned by bucket already."""
    name, (_, key, sort) = f"querent_{kind}_{uuid.uuid4().hex}", _shape(index, kind)
    n, path = index.state["buckets"], f"{index.folder}/{name}"
    rows = rows if dealt else rows.repartition(n, key)
    rows.sortWithinPartitions(*dict.fromkeys((sort, key))).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(sort).saveAsTable(name)
    entry, table = {"name": name, "seq": index.state["seq"] + 1}, index.spark.table(name)
    if kind != "segment":
        return entry | {"rows": table.count()}
    documents, words, tokens = _sums(table, "n_words", "length")
    return entry | {"rows": documents + words, "documents": documents, "tokens": tokens}


def _sums(rows: DataFrame, *columns: str) -> list[int]:
    """The number of rows and the sums of these columns."""
    return list(rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)) for c in columns]).first())


def _table(index: Index, entry: dict, kind: str) -> DataFrame:
    """Opens a table of the index, in a session that may not have seen it."""
    # Spark 4.1 takes a union of scans of equal buckets as still dealt by bucket, but runs it column-wise without keeping the
    # parts together, so that groups come out in pieces
    index.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if not index.spark.catalog.tableExists(entry["name"]):
        columns, key, sort = _shape(index, kind)
        index.spark.sql(f"CREATE TABLE {entry['name']} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({sort}) INTO {index.state['buckets']} BUCKETS LOCATION '{index.folder}/{entry['name']}'")
    return index.spark.table(entry["name"])


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _live(index: Index, kept=lambda rows: rows) -> list[DataFrame]:
    """The live chunks of each segment; `kept` filters a segment first."""
    out = []
    for s in index.state["segments"]:
        rows, later = kept(_table(index, s, "segment")), [m for m in index.state["marks"] if m["seq"] > s["seq"]]
        if later:
            gone = _union([_table(index, m, "marks") for m in later])
            small = sum(m["rows"] for m in later) <= SENT
            rows = rows.join(gone.hint("broadcast" if small else "shuffle_hash"), "chunk_id", "left_anti")
        out.append(rows)
    return out


def _by_term(chunks: DataFrame) -> DataFrame:
    """A row for each chunk and term."""
    rows = chunks.select("chunk_id", "owner", "acl_hash", "length", "n_words", F.inline(F.arrays_zip(*[F.split(c, " ").alias(c) for c in ("terms", "tfs")])))
    return rows.select("chunk_id", "owner", "acl_hash", "length", "n_words", F.col("terms").alias("term"), F.col("tfs").cast("bigint").alias("tf"))


def _chunks(index: Index) -> DataFrame:
    rows = _union(_live(index))
    return index.spark.createDataFrame([], _shape(index, "segment")[0]) if rows is None else rows


def live(index: Index) -> DataFrame:
    """All rows of a chunk and term that count, with one of the empty term for each chunk."""
    return _by_term(_chunks(index))


def tokenised(index: Index, chunks: DataFrame, text_col: str = "text", order: str | None = None) -> DataFrame:
    """Rows of a segment, dealt to its buckets: one shuffle, of the texts."""
    chunks = chunks.where("chunk_id is not null").repartition(index.state["buckets"], "chunk_id")
    heading = [F.array_join("heading_path", " ")] if "heading_path" in chunks.columns else []
    body = F.concat_ws(" ", *heading, F.coalesce(text_col, F.lit("")))
    last = Window.partitionBy("chunk_id").orderBy(*([F.desc_nulls_last(order)] if order else []), F.desc_nulls_last(text_col))
    rows = chunks.select(F.col("chunk_id").cast(index.state["id_type"]), F.col("tenant_id").alias("owner"), "acl_hash", body.alias("body"), F.row_number().over(last).alias("n")).where("n = 1")
    return rows.drop("n").mapInArrow(_with_terms, _shape(index, "segment")[0])


def _with_terms(batches):
    """Rows with their text (the last column) replaced by its length in tokens, its distinct tokens, these with the empty term,
    and the counts."""
    for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
        *kept, body = batch.columns
        length, n_words, terms, tfs = [], [], [], []
        for t in body.cast(pa.binary()).to_pylist():
            found = text.lexical_counts(t)
            length.append(found.total())
            n_words.append(len(found))
            terms.append(b" ".join([b"", *found]))
            tfs.append(1)
            tfs.extend(found.values())
        ends = np.cumsum([0, *n_words], dtype=np.int32) + np.arange(len(n_words) + 1, dtype=np.int32)
        tfs = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()).cast(pa.string())), " ")
        made = [pa.array(length, pa.int32()), pa.array(n_words, pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()), tfs]
        yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], "length", "n_words", "terms", "tfs"])


def _held(chunks: DataFrame, by: int) -> DataFrame:
    """term, df: in how many of these chunks each term is, times `by`, in several rows for a term."""

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(pc.split_pattern(batch.column(0), " ").flatten())
            n += len(parts[-1])
            if n >= COUNTED:
                yield _dfs(parts, by)
                parts, n = [], 0
        if n:
            yield _dfs(parts, by)

    return chunks.select("terms").mapInArrow(run, "term string, df bigint")


def _dfs(parts: list, by: int) -> pa.RecordBatch:
    found = pc.value_counts(pa.concat_arrays(parts))
    return pa.RecordBatch.from_arrays([found.field("values"), pc.multiply(found.field("counts"), by)], ["term", "df"])


def _committed(index: Index, added: dict | None, ids: dict, offered: int) -> Index:
    """The version with a batch: `added` its segment, `ids` its marks."""
    sent = _table(index, ids, "marks").hint("broadcast" if ids["rows"] <= SENT else "shuffle_hash")
    out = _union(_live(index, lambda rows: rows.join(sent, "chunk_id", "left_semi")))
    parts = [] if out is None else [_held(out, -1)]
    parts += [_held(_table(index, added, "segment"), 1)] if added else []
    state = index.state | {"seq": index.state["seq"] + 1, "marks": [*index.state["marks"], ids], "offered": offered}
    for documents, tokens in [] if out is None else [_sums(out, "length")]:
        state["documents"] -= documents
        state["tokens"] -= tokens
    if parts:
        change = _union(parts).where("term <> ''").repartition(state["buckets"], "term").groupBy("term").agg(F.sum("df").alias("df"))
        state["terms"] = [*state["terms"], _written(index, change.where("df <> 0"), "terms", dealt=True)]
    if added:
        state["documents"] += added["documents"]
        state["tokens"] += added["tokens"]
        state["segments"] = [*state["segments"], added]
    return Index(index.spark, index.folder, versions.commit(index.spark, index.folder, index.version, state), state)


def upserted(index: Index, chunks: DataFrame, text_col: str = "text", order: str | None = None) -> Index:
    """Adds chunks (chunk_id, tenant_id, acl_hash, a text, maybe heading_path), replacing those of the same id."""
    added = _written(index, tokenised(index, chunks, text_col, order), "segment", dealt=True)
    ids = _written(index, _table(index, added, "segment").select("chunk_id"), "marks", dealt=True)
    return _committed(index, added, ids, chunks.count())


def deleted(index: Index, ids: DataFrame) -> Index:
    """Takes out the chunks of these ids (chunk_id)."""
    marks = _written(index, ids.where("chunk_id is not null").select(F.col("chunk_id").cast(index.state["id_type"])).distinct(), "marks")
    return _committed(index, None, marks, ids.count())


def due(index: Index) -> bool:
    """Whether compaction pays."""
    sizes = [s["rows"] for s in index.state["segments"]]
    return len(index.state["marks"]) > MOST_BATCHES or len(sizes) > 1 and 2 * sum(sizes[1:]) >= sizes[0]


def compacted(index: Index) -> Index:
    """One segment of all that is live, one table of frequencies, no marks."""
    state = index.state | {"seq": index.state["seq"] + 1, "segments": [], "marks": [], "terms": []}
    if index.state["segments"]:
        state["segments"] = [_written(index, _chunks(index), "segment")]
        state["terms"] = [_written(index, frequencies(index), "terms")]
    return Index(index.spark, index.folder, versions.commit(index.spark, index.folder, index.version, state), state)


def frequencies(index: Index, kept=lambda rows: rows) -> DataFrame:
    """term, df of all live documents, from the changes alone; `kept` filters these first."""
    rows = _union([kept(_table(index, t, "terms")) for t in index.state["terms"]])
    rows = index.spark.createDataFrame([], "term string, df bigint") if rows is None else rows
    return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _kept(index: Index, rows: DataFrame) -> tuple[DataFrame, int]:
    path = f"{index.folder}/asked-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = index.spark.read.schema(rows.schema).parquet(path)
    return rows, rows.count()


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """term and df of the terms of the queries, to be sent to the segments if counted few."""
    terms, n = _kept(index, queries.select(F.explode(text.tokens(F.col("query_text"))).alias("term")).distinct())
    found, n = _kept(index, frequencies(index, lambda rows: rows.join(F.broadcast(terms) if n <= TERMS else terms, "term", "left_semi")))
    return F.broadcast(found) if n <= TERMS else found


def postings(index: Index, queries: DataFrame) -> DataFrame:
    """Live rows of the terms of the queries, with each term's df. What was replaced is taken out first, by chunks; then a
    join cuts the rows to these terms, and shuffles them only where the terms are too many to be sent."""
    terms = asked_terms(index, queries)
    rows = _union([_by_term(chunks).join(terms, "term") for chunks in _live(index)])
    return rows if rows is not None else live(index).withColumn("df", F.lit(None).cast("bigint"))


def counted(index: Index, terms: list[str]) -> DataFrame:
    """The live chunks with the terms of this list that they hold, by their number in it, in order: rows for blocks.best()."""
    rows = _chunks(index)
    sent = index.spark.sparkContext.broadcast(terms)

    def run(batches):
        names = pa.array(sent.value, pa.string())
        for batch in batches:
            *kept, held, tfs = batch.columns
            held, tfs = pc.split_pattern(held, " "), pc.split_pattern(tfs, " ").flatten()
            at = pc.index_in(held.flatten(), value_set=names)
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())[hit]
            term = at.take(pa.array(hit)).to_numpy()
            order = np.lexsort((term, row))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order], pa.int32())) for v in (term, tfs.take(pa.array(hit)).cast(pa.int32()).to_numpy())]
            yield pa.RecordBatch.from_arrays([*kept, *lists], batch.schema.names)

    return rows.mapInArrow(run, _shape(index, "segment")[0].replace("terms string, tfs string", "terms array<int>, tfs array<int>"))


def document_frequencies(index: Index, terms: list[str]) -> np.ndarray:
    """The df of each term of this list, which is counted small enough to be sent."""
    names = F.broadcast(index.spark.createDataFrame(pa.table({"n": pa.array(range(len(terms)), pa.int64()), "term": pa.array(terms, pa.string())})))
    found = frequencies(index, lambda rows: rows.join(names.select("term"), "term", "left_semi")).join(names, "term").select("n", "df").toArrow()
    df = np.zeros(len(terms), np.int64)
    df[found["n"].to_numpy()] = found["df"].to_numpy()
    return df


def statistics(index: Index) -> DataFrame:
    """n and mean_length as one row, from the version."""
    n = index.documents
    return index.spark.createDataFrame([(n, index.tokens / n if n else 0.0)], "n long, mean_length double")


def synced(index: Index, entries: DataFrame, changes: DataFrame) -> Index:
    """Takes over the changes between two snapshots (chunk_id, change; see ingestion.changes): added and changed entries are
    written, removed ones taken out, unchanged ones not touched. Without any the index stays at its version."""
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}  # four kinds
    if counts.get("removed"):
        index = deleted(index, changes.where("change = 'removed'"))
    if counts.get("added") or counts.get("changed"):
        index = upserted(index, entries.join(changes.where("change in ('added', 'changed')"), "chunk_id", "left_semi"))
    return index
