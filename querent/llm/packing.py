"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so bins are planned on the histogram of lengths (at most `capacity`
rows, whatever the input): fill a bin greedily with the longest pieces that fit, then put two unpacked pieces in the
place of its smallest one where they fit the expanded gap more tightly. A bin's pattern is repeated while its lengths
last. Pieces then take their places by their rank within their length, which is computed in salted parts.

Null text counts as empty (one piece: the separator alone). Repeated rows are packed as often as they occur. An empty
table gives no rows. Only documents longer than the capacity are cut; the first piece takes the remainder.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts_of

CAPACITY = 2048
#: Ranks of one length are dealt in parts of at least this many rows, and into PARTS parts over all lengths at most.
PART_ROWS, PARTS = 1000, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoders(json_path: str, ranks_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    return Tokenizer.from_file(json_path), tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_RARE = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


def encode_ids(text: str, json_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Token ids as the tokenizers library gives them. Latin texts go through the faster library that has the same
    vocabulary as ranks; others, and those that hold the special token's string, through tokenizers itself."""
    slow, fast = _encoders(json_path, ranks_path, pattern)
    if _RARE.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def tokenized_pieces(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row for each piece of at most `capacity` tokens; the separator ends each document."""
    import public_tokenizers as public

    json_path, ranks_path = json_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken")
    pattern = public.PATTERN

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode_ids(text or "", json_path, ranks_path, pattern), np.uint32(separator)).astype("<u4")
                ends = range(len(ids) - capacity * ((len(ids) - 1) // capacity), len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts_of(docs).mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of bins (lengths, longest first) with the number of bins of each, from the count of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    bins: list[tuple[list[int], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return bins
        taken: dict[int, int] = {}

        def free(length: int, taken=taken) -> int:
            return int(left[length]) - taken.get(length, 0)

        gap = capacity
        k = len(there) - 1
        while gap and k >= 0:
            k = min(k, int(np.searchsorted(there, gap, "right")) - 1)
            if k < 0:
                break
            length = int(there[k])
            n = min(free(length), gap // length)
            if n:
                taken[length] = taken.get(length, 0) + n
                gap -= n * length
            k -= 1
        least = min(taken)
        if gap and (pair := _tighter_pair(there, left, taken, least, gap + least)):
            taken[least] -= 1
            for length in pair:
                taken[length] = taken.get(length, 0) + 1
        taken = {length: n for length, n in taken.items() if n}
        times = min(int(left[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= n * times
        bins.append(([length for length in sorted(taken, reverse=True) for _ in range(taken[length])], times))


def _tighter_pair(there: np.ndarray, left: np.ndarray, taken: dict[int, int], least: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of the largest sum over `least` and within `room`."""
    free = np.array([left[x] - taken.get(int(x), 0) for x in there])
    lengths, free = there[free > 0], free[free > 0]
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    own = at == np.arange(len(lengths))
    at = np.where(own & (free < 2), at - 1, at)
    sums = np.where(at >= 0, lengths + lengths[np.maximum(at, 0)], 0)
    best = int(np.argmax(sums))
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] > least else None


def _slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks, sorted by length and first rank."""
    rows, given, first_bin = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rank = given.get(length, 0)
            rows.append((length, rank, each, first_bin, offset))
            given[length] = rank + each * times
            offset += each * length
        first_bin += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "bin", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity). `pieces` is read more than once."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_bins(counts, capacity))
    per_part = max(PART_ROWS, sum(counts.values()) // PARTS)
    spark = pieces.sparkSession
    parts = spark.createDataFrame([(length, -(-n // per_part)) for length, n in counts.items()], "length long, _parts long")
    # at most `capacity` rows, whatever the input
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), "_parts")).drop("_parts")
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).collect()  # PARTS + capacity rows at most
    before, starts = {}, []
    for r in sorted(sizes, key=lambda r: (r["length"], r["_part"])):
        starts.append((r["length"], r["_part"], before.get(r["length"], 0)))
        before[r["length"]] = starts[-1][2] + r["n"]
    firsts = spark.createDataFrame(starts, "length long, _part long, _first long")
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - F.lit(1)).join(F.broadcast(firsts), ["length", "_part"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_first")).alias("_rank"))
    span = int(max(counts.values(), default=0)) + 1
    keys = slots["length"] * span + slots["rank"]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, length * span + rank, "right") - 1
            nth, each = rank - slots["rank"][k], slots["each"][k]
            out = [pa.array(slots["bin"][k] + nth // each), pa.array(slots["offset"][k] + nth % each * length)]
            keep = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, *out], [*keep.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises whole documents, cuts the long ones and packs the pieces."""
    return pack(stored(tokenized_pieces(docs, capacity=capacity), "pieces"), capacity)
