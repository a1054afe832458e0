"""Canonical exact digests of documents.

A text's canonical form: Unicode normalisation (NFKC), case folding, white space runs to one space, none at the ends. Its
fingerprint is the 128-bit xxhash of that form. Equal fingerprints are not trusted: within a bucket of equal hashes the
canonical bytes are grouped themselves, and a text whose bytes differ from the bucket's first gets a suffix of its own.

As fingerprints are exact, likeness is 1 where the canonical forms are equal and 0 elsewhere.

Documents are put into descending order of doc_id by parts: splitters deal the rows to ordered parts, and each part also
gets the first document of the next. Null text counts as empty. Rows with null doc_id come last in the order; rows of
equal doc_id are ordered by their text. A single row is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_docs, sent_if_small, small_batches, stored, texts_of

#: Splitters are approximate quantiles of doc_id with this relative error of a part.
_ACCURACY = 10


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.casefold().split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, verified within its bucket."""

    def make(doc_ids, texts):
        return {"doc_id": doc_ids, "fingerprint": pa.array([digest(canonical(t)) for t in texts], pa.string())}

    docs = texts_of(docs)
    return verified(docs, stored(map_docs(docs, make, "doc_id long, fingerprint string"), "digests"))


def verified(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """`hashed` (stored; has doc_id and fingerprint) with a suffix where unequal bytes share a bucket."""
    buckets = hashed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    buckets = sent_if_small(stored(buckets, "several"))
    several = stored(hashed.join(buckets, "fingerprint", "left_semi").where("doc_id is not null").select("doc_id", "fingerprint").distinct(), "buckets")
    if several.count() <= BROADCAST_ROWS:  # counted; beyond it the texts are shuffled
        several = F.broadcast(several)

    def forms(doc_ids, texts):
        found = [canonical(t) for t in texts]
        return {"doc_id": doc_ids, "fingerprint": pa.array([digest(f) for f in found], pa.string()), "form": pa.array(found, pa.binary())}

    texts = texts_of(docs).join(several.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    # grouping by the bytes themselves compares them; copies meet before the shuffle
    groups = map_docs(texts, forms, "doc_id long, fingerprint string, form binary").groupBy("fingerprint", "form").agg(F.min("doc_id").alias("first"))
    split = stored(groups.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("first")).alias("firsts")).where("n > 1"), "collisions")
    if not split.take(1):
        return hashed
    # two texts under one 128-bit hash: number the forms by their first document
    again = map_docs(texts_of(docs), forms, "doc_id long, fingerprint string, form binary").join(F.broadcast(split.select("fingerprint")), "fingerprint")
    order = Window.partitionBy("fingerprint").orderBy("first", "form")
    numbered = again.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("first")).withColumn("k", F.row_number().over(order) - 1)
    suffix = again.join(numbered, ["fingerprint", "form"]).where("k > 0").select("doc_id", "fingerprint", "k").distinct()
    out = hashed.join(suffix, ["doc_id", "fingerprint"], "left")
    return out.select(*[F.concat_ws("-", "fingerprint", F.col("k").cast("string")).alias(c) if c == "fingerprint" else F.col(c) for c in hashed.columns])


def _ordered_parts(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, extra: rows dealt to parts of descending doc_id; an extra row is the first of the next part."""
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", shares, parts * _ACCURACY).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    # one number for each part; rows of one doc_id share a part, null doc_ids the last
    part = F.lit(len(cuts))
    if cuts:
        edges = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(edges, lambda c: c >= F.col("doc_id"))))
    dealt = docs.withColumn("part", part)
    # the first document of each part (a part holds whole doc_ids): one row for each part
    heads = dealt.select("part", "doc_id", F.struct((-F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).alias("place"))
    heads = sorted((r["part"], r["doc_id"]) for r in heads.groupBy("part").agg(F.min_by("doc_id", "place").alias("doc_id")).collect())
    follows = [(heads[k - 1][0], doc_id, p) for k, (p, doc_id) in enumerate(heads)]
    head = docs.sparkSession.createDataFrame(follows, "to long, head long, part long")
    extra = dealt.join(F.broadcast(head), (F.col("doc_id").eqNullSafe(F.col("head"))) & (dealt["part"] == head["part"]))
    # all versions of that doc_id may follow; the one that is first by hash is taken within the part
    extra = extra.select("doc_id", "text", F.col("to").cast("int").alias("part"), F.lit(True).alias("extra"))
    return dealt.select("doc_id", "text", F.col("part").cast("int"), F.lit(False).alias("extra")).union(extra)


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each whole text, and how alike they are to those of its edited text and of the next document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _ordered_parts(docs, parts).withColumn("h", F.xxhash64("text")).repartition(parts, "part")
    rows = rows.sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "h", "text").select("doc_id", "text", "part", "extra")
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def row(doc_id, text, after):
        n = len(text)
        changed = text[: n - n // 3] + after[: n // 3]
        form, changed_form = canonical(text), canonical(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, n, sha, digest(form), digest(changed_form), float(form == changed_form), float(form == canonical(after))

    def run(batches):
        held, closed = None, None  # the row that waits for its next; the part that has had its extra row
        for batch in batches:
            out = []
            for doc_id, text, part, extra in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part == closed:
                    continue
                if held is not None and held[2] == part:
                    out.append(row(held[0], held[1], text))
                held = (doc_id, text, part)
                if extra:
                    held, closed = None, part
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return verified(docs, stored(rows.mapInArrow(run, schema), "likeness"))
