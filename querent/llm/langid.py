"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every learning document. The weights are learnt with follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties) on at most SAMPLE_PER_LANG documents of each language and SAMPLE_PAIRS n-gram
counts in all, those of the lowest hash of doc_id; every fifth of them is kept back and sets the temperature that
calibrates the scores. Every language that a learning document has is learnt.

Null text, or text without a letter: `und` with score 0. Nothing to learn from (an empty table, no language given):
`und` for all. A single language: that language. Repeated rows are predicted alike. Rows with null doc_id are
predicted but never learnt from, as it is not known on which side of the split they are. Very long texts are counted
piece by piece, with the same counts as in one piece. Further columns are not looked at, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_docs, small_batches, stored

#: Character n-grams are hashed into this many buckets (a power of two).
BUCKETS = 1 << 15
NGRAMS = (1, 2, 3)
#: Documents of one language that the weights are learnt from, at most, and n-gram counts of all of them together.
SAMPLE_PER_LANG, SAMPLE_PAIRS = 600, 20_000_000
FOLDS, HELD_OUT = 5, 0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 4
UNKNOWN = "und"
#: Characters that are counted at once.
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    if not text.isascii():
        return any(c.isalpha() for c in text)
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the lower-cased text and how often; letters and the gaps between words count."""
    lower = f" {unicodedata.normalize('NFC', text).lower()} "
    counts, tail = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint32)
    for at in range(0, len(lower), _CHUNK):
        codes = np.frombuffer(lower[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        letter = (codes >= 0xC0) | ((codes >= 97) & (codes <= 122))
        codes = np.where(letter, codes, np.uint32(32))
        before = np.append(tail[-1:] if len(tail) else np.uint32(0), codes[:-1])
        # the last codes of the piece before, so that n-grams across the border count, and count once
        codes = np.concatenate([tail, codes[(codes != 32) | (before != 32)]])
        value = np.zeros(len(codes), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            value = value[: max(0, len(codes) - n + 1)] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            if n in NGRAMS:
                mixed = value[max(0, len(tail) - n + 1) :]
                mixed = mixed ^ (mixed >> np.uint32(15))
                mixed = (mixed * np.uint32(0x2C1B3C6D)) ^ (mixed >> np.uint32(12))
                counts += np.bincount(mixed % np.uint32(BUCKETS), minlength=BUCKETS)
        tail = codes[1 - max(NGRAMS) :]
    there = np.flatnonzero(counts)
    return there, counts[there]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, there: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[there]
        return values / (np.sqrt((values * values).sum()) or 1.0)

    def scores(self, there: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(there, counts) @ self.weights[there] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.scores(*ngram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (a row for each bucket, the last for the bias) after EPOCHS passes over the rows in their order."""
    z, n = np.zeros((BUCKETS + 1, len(model.langs))), np.zeros((BUCKETS + 1, len(model.langs)))

    def lazily(at):
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) > L1, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    prepared = [(np.append(there, BUCKETS), np.append(model.features(there, counts), 1.0), y) for there, counts, y in rows]
    for _ in range(EPOCHS):
        for at, x, y in prepared:
            w = lazily(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return lazily(slice(None))


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, on a grid of ratios; 1 where nothing was kept back."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _labelled(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), fold.alias("fold"))


def document_frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """In how many learning documents each bucket occurs: each task sums its own, then the sums are summed by parts."""

    def count(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[ngram_counts(text)[0]] += 1
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "seen": pa.array([np.append(seen, n).tolist()], pa.list_(pa.int64()))})

    sums = learning.select("text").mapInArrow(count, "part int, seen array<long>")
    by_bucket = sums.select(F.posexplode("seen").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in by_bucket.collect():  # BUCKETS + 1 rows at most
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from text and lang of the documents outside the held-out fold."""
    learning = _labelled(docs).where(f"fold <> {HELD_OUT} and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in learning.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    seen, n = document_frequencies(learning)
    model = Model(langs, np.log((1 + n) / (1 + seen)) + 1, np.zeros((BUCKETS + 1, len(langs))))
    if not langs:
        return model
    # the hash bound lets through about 1.2 samples of each language, so that no task gathers a language
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.2 * sample_per_lang / sizes[k]))]), F.col("lang"))
    keyed = learning.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    keyed = keyed.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_per_lang)
    chosen = chosen.select("doc_id", "lang", "h", "rank").dropDuplicates(["doc_id"])

    def make(doc_ids, texts):
        found = [ngram_counts(t) for t in texts]
        return {"doc_id": doc_ids, "there": pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), "counts": pa.array([b.tolist() for _, b in found], pa.list_(pa.int32()))}

    # sample_per_lang rows of two numbers for each language
    picked = learning.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    counted = stored(map_docs(picked, make, "doc_id long, there array<int>, counts array<int>").join(F.broadcast(chosen), "doc_id"), "sample")
    held, taken = 0, []
    for r in counted.select("doc_id", F.size("there").alias("n")).orderBy("h", "doc_id").collect():
        held += r["n"]
        if held <= SAMPLE_PAIRS:
            taken.append((r["doc_id"],))
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long"))
    rows = counted.join(taken, "doc_id", "left_semi").orderBy("h", "doc_id").collect()
    rows = [(r["rank"], (np.array(r["there"], np.int64), np.array(r["counts"], np.int64), langs.index(r["lang"]))) for r in rows]
    fit = [x for rank, x in rows if rank % 5]
    kept_back = [x for rank, x in rows if not rank % 5]
    model.weights = ftrl(model, fit)
    model.temperature = calibrated(np.array([model.scores(a, b) for a, b, _ in kept_back]), np.array([y for *_, y in kept_back], np.int64))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def make(doc_ids, texts):
        found = [shared.value.predict(t) for t in texts]
        fold = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in doc_ids.to_pylist()]
        return {"doc_id": doc_ids, "held_out": pa.array(fold, pa.bool_()), "lang_pred": pa.array([a for a, _ in found], pa.string()), "score": pa.array([b for _, b in found], pa.float64())}

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_docs(texts, make, "doc_id long, held_out boolean, lang_pred string, score double")


def language_of(text: Column, model: Model) -> Column:
    """The predicted language of a text column (`und` where there is none), as an expression within a row."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(t)[0] for t in texts], dtype=object)

    return predicted(text)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows with a recognised language, all columns kept. Where no language is learnt, the rows that have a letter."""
    small_batches(docs.sparkSession)
    model, text = train(docs), F.col("text").cast("string")
    if not model.langs:
        return docs.where(text.rlike(r"\p{L}"))
    return docs.where(language_of(text, model) != UNKNOWN)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
