"""Substring deduplication with a log-structured index of fingerprints.

A window is `width` consecutive words. Of its runs of `gram` words the one of least hash is its fingerprint, so equal
windows have equal fingerprints and a document needs few of them. The index is a list of immutable runs of
(fingerprint, document), sorted by fingerprint. A new batch becomes a run of its own; it is merge-joined with the runs of
earlier batches to find fingerprints that several documents share, and runs of one level are compacted into a run of the
next. Shared fingerprints are verified on the texts: the windows that have them are compared by two 64-bit hashes of all
their words, and a window is a repeat if the same window starts in a document of smaller doc_id. Documents of equal
words need no windows: all but the first are repeats as a whole.

Null and empty texts have no words: nothing is removed and the digest is that of nothing. Texts under `width` words have
no window. Rows with null doc_id are returned whole and are never a source. Rows that repeat a doc_id are versions of one
document, which never remove words from each other. Very long texts are taken whole. Further columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, lowest, rolling, sent_if_small, small_batches, stored

WIDTH, GRAM = 50, 25
#: Batches that a whole table is added in, and runs of one level that are compacted into one of the next.
BATCHES, FANOUT = 3, 2
#: Removed stretches that are broadcast with their documents at most.
SENT_STRETCHES = 1_000_000
_SECOND_BASE = 0xD1342543DE82EF95
#: Two independent hashes of a word, so that windows compared by both differ where either does.
_words, _others = WordHashes(1), WordHashes(2)


def words_of(text: str | None) -> list[bytes]:
    """Runs of what isn't ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def fingerprints(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The fingerprint of each window."""
    return lowest(rolling(hashes, gram), width - gram + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))


class SubstringIndex:
    """The runs of all batches so far. `docs` given to repeats() must hold the documents that were added."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.width, self.gram, self.fanout = spark, width, min(gram, width), fanout
        self.runs: list[tuple[int, DataFrame]] = []
        self.copies: list[DataFrame] = []
        self.shared: list[DataFrame] = []

    def _sketch(self, docs: DataFrame) -> DataFrame:
        width, gram = self.width, self.gram

        def make(batches):
            for batch in batches:
                ids, versions, whole, prints = [], [], [], []
                for doc_id, text, version in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    hashes = _words.of(words_of(text))
                    if len(hashes) >= width:
                        ids.append(doc_id)
                        versions.append(version)
                        whole.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                        prints.append(np.unique(fingerprints(hashes, width, gram)).view(np.int64))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "version": pa.array(versions, pa.int64()), "whole": pa.array(whole, pa.binary()), "prints": pa.array(prints, pa.list_(pa.int64()))})

        return docs.where("doc_id is not null").mapInArrow(make, "doc_id long, version long, whole binary, prints array<long>")

    def _history(self) -> DataFrame:
        out = self.spark.createDataFrame([], "print long, doc_id long, version long, whole binary")
        for _, run in self.runs:
            out = out.union(run)
        return out

    def add(self, docs: DataFrame) -> None:
        """Adds a batch: its copies of earlier texts, its run, and the fingerprints that it shares with the runs."""
        sketch = stored(self._sketch(_keyed(docs)), "sketch")
        new_whole = sketch.select("whole", "doc_id", "version")
        wholes = self._history().where("whole is not null").select("whole", "doc_id", "version")
        # stored, so that a text of very many copies can be split where it meets its first document
        first = sent_if_small(stored(new_whole.union(wholes).groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "wholes"))
        copies = stored(new_whole.join(first, "whole").where("first < doc_id").select("doc_id", "version").distinct(), "copies")
        self.copies.append(copies)
        fresh = sketch.join(copies, ["doc_id", "version"], "left_anti")
        rows = fresh.select(F.explode("prints").alias("print"), "doc_id", "version", F.lit(None).cast("binary").alias("whole"))
        rows = rows.union(fresh.select(F.lit(None).cast("long"), "doc_id", "version", "whole"))
        # runs are sorted by fingerprint; the rows that hold whole texts are dealt by document instead
        run = stored(self._sorted(rows), "run")
        now, before = run.where("print is not null"), self._history().where("print is not null")
        met = now.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        old = before.hint("merge").join(met.select("print"), "print", "left_semi")
        known = old.groupBy("print").agg(F.min("doc_id").alias("old"))
        both = met.join(known, "print", "left").where("low < high or old is not null").select("print")
        pairs = now.union(before).hint("merge").join(both, "print")
        self.shared.append(stored(pairs.select("doc_id", "version", "print"), "shared"))
        self.runs.append((0, run))
        self._compact()

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(F.coalesce("print", "doc_id")).sortWithinPartitions("print")

    def _compact(self) -> None:
        while self.runs and sum(level == self.runs[-1][0] for level, _ in self.runs) >= self.fanout:
            level = self.runs[-1][0]
            union = None
            for _, run in (x for x in self.runs if x[0] == level):
                union = run if union is None else union.union(run)
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, stored(self._sorted(union), "run"))]

    def repeats(self, docs: DataFrame) -> DataFrame:
        """doc_id, version, and begins and ends of the stretches of words that repeat a document of smaller doc_id."""
        shared = self.shared[0]
        for more in self.shared[1:]:
            shared = shared.union(more)
        lists = stored(shared.groupBy("doc_id", "version").agg(F.collect_set("print").alias("prints")), "lists")
        ids = sent_if_small(lists.select("doc_id", "version"))
        width, gram = self.width, self.gram
        # the lists themselves may be large, so they are joined by a shuffle of the documents that have one
        texts = _keyed(docs).join(ids, ["doc_id", "version"], "left_semi").hint("merge").join(lists, ["doc_id", "version"]).select("doc_id", "version", "text", "prints")

        def windows(batches):
            for batch in batches:
                prints = batch.column("prints")
                for k, (doc_id, version, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True)):
                    words = words_of(text)
                    hashes = _words.of(words)
                    known = np.sort(prints[k].values.to_numpy())
                    mine = fingerprints(hashes, width, gram).view(np.int64)
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    start = np.flatnonzero(known[at] == mine)
                    if len(start):
                        n = len(start)
                        yield pa.RecordBatch.from_pydict({
                            "one": pa.array(rolling(hashes, width)[start].view(np.int64)),
                            "two": pa.array(rolling(_others.of(words), width, _SECOND_BASE)[start].view(np.int64)),
                            "doc_id": pa.array(np.full(n, doc_id, np.int64)),
                            "version": pa.array(np.full(n, version, np.int64)),
                            "start": pa.array(start.astype(np.int32)),
                        })

        found = texts.mapInArrow(windows, "one long, two long, doc_id long, version long, start int")
        first = found.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        # stored, so that a window that very many documents share can be split where it meets its first document
        hits = found.join(stored(first, "firsts"), ["one", "two"]).where("first < doc_id")
        starts = hits.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("start")).alias("starts"))

        def stretches(batches):
            for batch in batches:
                begins, ends = [], []
                for found in batch.column("starts"):
                    at = found.values.to_numpy()
                    apart = np.flatnonzero(np.diff(at) > width) + 1
                    begins.append(at[np.append(0, apart)])
                    ends.append(at[np.append(apart - 1, len(at) - 1)] + width)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "version": batch.column("version"), "begins": pa.array(begins, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})

        return starts.mapInArrow(stretches, "doc_id long, version long, begins array<int>, ends array<int>")

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """Each row's doc_id, text of the kept words, and counts of all and of removed words."""
        gone = stored(self.repeats(docs), "repeats")
        copies = self.copies[0]
        for more in self.copies[1:]:
            copies = copies.union(more)
        none = F.lit(None).cast("array<int>")
        gone = gone.withColumn("copy", F.lit(False)).union(copies.select("doc_id", "version", none, none, F.lit(True)))
        size = gone.agg(F.sum(F.greatest(F.lit(1), F.size("begins")))).first()[0] or 0
        if size <= SENT_STRETCHES:  # counted; beyond it the texts are shuffled
            gone = F.broadcast(gone)
        joined = _keyed(docs).join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "begins", "ends", "copy")

        def keep(batches):
            for batch in batches:
                texts, total, removed = [], [], []
                begins, ends = batch.column("begins"), batch.column("ends")
                for k, (text, copy) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                    words = words_of(text)
                    n = len(words)
                    if copy:
                        words = []
                    elif begins[k].is_valid:
                        edges = [0, *(x for pair in zip(begins[k].as_py(), ends[k].as_py(), strict=True) for x in pair), n]
                        words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    total.append(n)
                    removed.append(n - len(words))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

        return joined.mapInArrow(keep, "doc_id long, text string, n_words long, n_removed long")


def substring_deduplicated(docs: DataFrame, batches: int = BATCHES, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Adds the table in batches of ascending doc_id and removes what repeats."""
    index = SubstringIndex(docs.sparkSession, width, gram)
    shares = [k / batches for k in range(1, batches)]
    cuts = (docs.select(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] or []) if shares else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        index.add(part if high is None else part.where(F.col("doc_id") <= high))
    return index.cleaned(docs)


def substring_digests(docs: DataFrame) -> DataFrame:
    kept = substring_deduplicated(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
