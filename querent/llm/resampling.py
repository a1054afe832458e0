"""Importance resampling of documents towards a target text distribution.

Features are all runs of one and two consecutive words, hashed to BUCKETS buckets (CRC-32 of their UTF-8 bytes). Counts over
all documents and over all target texts give each bucket a gain, its scaled log ratio; a document's weight is the mean gain
of its features, and its score adds Gumbel noise that a hash of its doc_id fixes, so that the highest scores are a draw
without replacement in proportion to the weights.

Counting: each task sums an array of buckets, so that BUCKETS rows a task meet, and BUCKETS rows reach the driver. Scoring:
the gains, an array of that fixed size, go to the tasks and index the buckets of a document.

Selection: of N documents the k-th key (highest score, then smallest doc_id) is found by rounds of weighted
median-of-medians. Keys are stored in order within their partition; each partition gives the counts below and above the
pivot and the medians of both sides; the median of these, weighted by what remains of each partition, is the next pivot, so
that a quarter at least is discarded a round. When FEW keys or fewer remain they are read at once. Winners are sorted by
ranges and numbered from the counts of the ranges; nobody else is sorted over all.

A row for every document. Null text: no words (n_features and weight 0). Null doc_id hashes as an empty string and comes
after all others among equal scores. Rows of one doc_id have the same noise; where they tie, fewer features go first, and
equal rows are told apart by their order. Long texts are hashed in portions, whole. An empty table gives no rows; no target
text at all leaves gains of equal sign for all. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored, texts_of

BUCKETS, SCALE, SEED = 10_000, 1000, 7
PERCENT, LEAST_WORDS = 25, 20
#: Keys that may be read by the driver at once to end the selection: 16 bytes each.
FEW = 4096
#: Bytes of text hashed at once.
PORTION = 1 << 20
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_NULL = np.iinfo(np.int64).max


def _shift_tables(most: int) -> np.ndarray:
    """[n, k, v]: what n zero bytes make of a CRC register with v in byte k; the register is linear, so bytes add by xor."""
    poly, byte = np.uint32(0xEDB88320), np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ poly, byte >> 1)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(most):
        now = (now >> 8) ^ byte[now & 255]
        out.append(now)
    return np.stack(out)


_LONGEST = 64
_SHIFT = _shift_tables(_LONGEST)


def crc_joined(first: np.ndarray, lengths: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of each first text followed by the second one, from both CRCs and the second's length (_LONGEST at most)."""
    out = second.copy()
    for k in range(4):
        out ^= _SHIFT[lengths, k, (first >> np.uint32(8 * k)) & 255]
    return out


def portions(texts: list[str | None]):
    """Lists of (index of the text, words, whether the first of them was the last one before): about PORTION bytes each."""
    held, size = [], 0
    for k, text in enumerate(texts):
        data = (text or "").encode().lower()  # of bytes: A to Z alone
        at, last = 0, None
        while at < len(data):
            gap = _GAP.search(data, at + PORTION) if at + PORTION < len(data) else None
            end = gap.start() if gap else len(data)
            words = _WORD.findall(data, at, end)
            if words:
                held.append((k, words if last is None else [last, *words], last is not None))
                last = words[-1]
            size, at = size + end - at, end
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


def hashed(held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and bucket of each feature of a portion, and the owner of each word."""
    ids = defaultdict()
    ids.default_factory = ids.__len__
    words = [w for _, ws, _ in held for w in ws]
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    crc = np.fromiter(map(zlib.crc32, ids), np.uint32, len(ids))
    after = np.fromiter((zlib.crc32(b" " + w) for w in ids), np.uint32, len(ids))
    length = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
    counts = np.array([len(ws) for _, ws, _ in held])
    owner = np.repeat([k for k, _, _ in held], counts)
    starts = np.cumsum(counts) - counts
    one, two = np.ones(len(words), bool), np.ones(len(words), bool)
    one[starts[[again for _, _, again in held]]] = False
    two[starts] = False
    pairs = np.flatnonzero(two)
    first, second = at[pairs - 1], at[pairs]
    joined = crc_joined(crc[first], np.minimum(length[second], _LONGEST), after[second])
    for k in np.flatnonzero(length[second] > _LONGEST):
        joined[k] = zlib.crc32(b" " + words[pairs[k]], int(crc[first[k]]))
    return np.concatenate([owner[one], owner[pairs]]), np.concatenate([crc[at[one]], joined]) % BUCKETS, owner[one]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all the texts each bucket has; `texts` has an id and the text."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for held in portions(batch.column(1).to_pylist()):
                total += np.bincount(hashed(held)[1], minlength=BUCKETS)
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int64), "n": total[some]})

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS at most
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for held in portions(batch.column(1).to_pylist()):
                owner, buckets, of_words = hashed(held)
                words += np.bincount(of_words, minlength=n)
                features += np.bincount(owner, minlength=n)
                total += np.bincount(owner, gain[buckets], n).astype(np.int64)  # sums of a portion are exact in doubles
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            ids = batch.column(0)
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": words, "n_features": features, "weight": weight, "score": score})

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _below(a, b, key):
    return (a < key[0]) | ((a == key[0]) & (b < key[1]))


def _before(key, a, b) -> Column:
    """Whether a key lies before (a, b), either of them columns."""
    x, y, a, b = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (*key, a, b))
    return (x < a) | ((x == a) & (y < b))


def _sides(keys: DataFrame, low, high, pivot) -> list:
    """For each partition: how many of its keys between low and high (both excluded) are below, at and above the pivot, and
    the medians of those below and above. Without a pivot all are above."""

    def run(batches):
        a, b = [], []
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.ones(len(x), bool)
            if low:
                keep &= ~_below(x, y, low) & ~((x == low[0]) & (y == low[1]))
            if high:
                keep &= _below(x, y, high)
            a.append(x[keep])
            b.append(y[keep])
        a, b = np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])
        order = np.lexsort((b, a))  # stored in order, so this only merges what a task reads of several files
        a, b = a[order], b[order]
        under = int(_below(a, b, pivot).sum()) if pivot else 0
        same = int(((a == pivot[0]) & (b == pivot[1])).sum()) if pivot else 0
        over = len(a) - under - same
        middle = lambda start, n: [int(a[start + (n - 1) // 2]), int(b[start + (n - 1) // 2])] if n else [0, 0]
        row = [under, same, over, *middle(0, under), *middle(under + same, over)]
        if len(a):
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(_SIDES, row, strict=True)})

    if low:
        keys = keys.where(F.col("a") >= low[0])
    if high:
        keys = keys.where(F.col("a") <= high[0])
    return keys.mapInArrow(run, ", ".join(f"{c} long" for c in _SIDES)).collect()  # a row for each partition


_SIDES = ("under", "same", "over", "ua", "ub", "oa", "ob")


def weighted_median(medians: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    medians = sorted(medians)
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple[int, int]:
    """The k-th smallest (a, b) of `keys` (stored), k from 1 to their number."""
    low = high = pivot = None
    need = k
    while True:
        sides = _sides(keys, low, high, pivot)
        under, same = sum(r.under for r in sides), sum(r.same for r in sides)
        if pivot and under < need <= under + same:
            return pivot
        if need <= under:
            high, rest = pivot, [((r.ua, r.ub), r.under) for r in sides if r.under]
        else:
            low, need, rest = pivot or low, need - under - same, [((r.oa, r.ob), r.over) for r in sides if r.over]
        if sum(n for _, n in rest) <= few:
            part = keys.where(_before(low, F.col("a"), F.col("b"))) if low else keys
            part = part.where(_before((F.col("a"), F.col("b")), *high)) if high else part
            return sorted((r.a, r.b) for r in part.collect())[need - 1]
        pivot = weighted_median(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, few: int = FEW) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text), towards the texts of `target` (id, text)."""
    docs = texts_of(docs)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    key = [(-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(_NULL)).alias("b")]
    rows = stored(scored(docs, gain, seed).select("*", *key).sortWithinPartitions("a", "b"), "scored")
    able = F.col("n_words") >= least
    k = percent * rows.where(able).count() // 100
    none = F.lit(None).cast("long").alias("rank")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*names, none)
    a, b = cutoff(rows.where(able).select("a", "b"), k, few)
    drawn = able & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b)))
    order = ["a", "b", "n_features"]
    winners = rows.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    winners = stored(winners.withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND((1 << 33) - 1)}), "winners")
    sizes = winners.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("place") + 1
    winners = winners.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    winners = winners.withColumn("rank", F.when(rank <= k, rank))  # repeats of the last key may be too many
    return rows.where(~drawn).select(*names, none).unionByName(winners.select(*names, "rank"))


def resampled_documents(spark, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark's texts."""
    target = texts_of(read(spark, sf_dir, "benchmark"), "item_id")
    return resampled(read(spark, sf_dir, "documents"), target).drop("n_words")
