"""Helpers shared by the operators of this subpackage: shared storage, batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch at most; texts can be long, so a batch must stay small.
BATCH_ROWS = 256
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, as in tests, a temporary one
    serves a local master; on a cluster that would lose rows, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="querent-"))
    return _OWN_DIR[0]


def stored(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def deleted(df: DataFrame) -> None:
    """Deletes a stored() table that no later result reads."""
    spark, path = df.sparkSession, _PATHS.pop(df)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session, so that batches of long texts fit in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; whatever else a table has cannot clash with an operator's own columns."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_docs(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow where make(doc_ids, texts) gives a dict of columns for one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = make(batch.column(0), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen lately: two generations of `most` words at most."""

    def __init__(self, seed: int = 0, most: int = 60_000):
        super().__init__()
        self.seed, self.most, self.before = seed, most, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.get(word)
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed) if value is None else value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: spreads what sums of products leave in the high bits."""
    v = values.copy()
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def rolling(hashes: np.ndarray, width: int, base: int = _ODD) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (Horner's rule modulo 2^64, then mixed)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    span, done = hashes, 0
    # powers of two of the width are joined, so that a width costs log2(width) passes
    weight, length, blocks = base & _MASK, 1, span
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            total = total * np.uint64(pow(base, 1 << bit, 1 << 64)) + blocks[done : done + n]
            done += 1 << bit
        if width >> (bit + 1):
            blocks = blocks[: len(blocks) - length] * np.uint64(pow(weight, length, 1 << 64)) + blocks[length:]
            length *= 2
    return mixed(total)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span, have = values, 1
    while have * 2 <= width:
        span, have = np.minimum(span[: len(span) - have], span[have:]), have * 2
    return np.minimum(span[:n], span[width - have : width - have + n])


#: Rows and bytes that a side may have to be broadcast. Beyond either a join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _bytes_of(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        held = F.octet_length(F.array_join(c, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return F.coalesce(F.greatest(F.size(c), F.lit(0)) * 16 + held, F.lit(0))
    return F.coalesce(F.octet_length(c), F.lit(0)) if isinstance(kind, T.StringType | T.BinaryType) else F.lit(16)


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (stored, so that counting is cheap) with a broadcast hint if its counted rows and bytes are few."""
    width = sum((_bytes_of(f.name, f.dataType) for f in df.schema), F.lit(16))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df
