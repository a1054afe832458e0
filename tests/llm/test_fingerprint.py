import hashlib
import random

import pytest

from querent.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, part string, extra string, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "p", "e", "f") for d, t in rows], SCHEMA)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        changed = t[: n - n // 3] + after[: n // 3]
        out.append((d, n, hashlib.sha256(changed.encode()).hexdigest(), fp.digest(fp.canonical(t)), fp.digest(fp.canonical(changed)), float(fp.canonical(t) == fp.canonical(changed)), float(fp.canonical(t) == fp.canonical(after))))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_matches_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(d, rng.choice(["", None, "ﬁne Straße", "FINE  strasse", "x" * 9000, "aé漢😀" * rng.randrange(20), f"text {d}"])) for d in rng.sample(range(10_000), 120)]
    assert sorted(map(tuple, fp.edited_likeness(frame(spark, rows), parts).collect())) == brute(rows)


def test_few_rows_nulls_and_repeats(spark):
    assert fp.edited_likeness(frame(spark, [])).count() == 0
    (one,) = fp.edited_likeness(frame(spark, [(4, "abcdef")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(4, "abcdef"), (4, "abcdef"), (4, "other"), (None, "null id"), (None, None), (9, "nine")]
    got = fp.edited_likeness(frame(spark, rows), 4).collect()
    assert len(got) == 6 and {r.fingerprint for r in got if r.doc_id == 4} == {fp.digest(b"abcdef"), fp.digest(b"other")}


def test_folding():
    assert fp.canonical("ＦＵＬＬ  Straße\n") == fp.canonical("full STRASSE") == b"full strasse"
    assert fp.canonical("é") == fp.canonical("é")


def test_unequal_bytes_in_a_bucket_are_told_apart(spark, monkeypatch):
    rows = [(1, "a"), (2, "B"), (3, "b "), (4, "a"), (5, "c")]

    def digests(docs):
        hashed = frame(spark, rows).selectExpr("doc_id", "'same' as fingerprint")
        return hashed

    # a digest that collides: everything is in one bucket
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(fp)
    monkeypatch.setattr(fp, "digest", lambda form: "same")
    got = {r.doc_id: r.fingerprint for r in fp.verified(frame(spark, rows), digests(rows)).collect()}
    cloudpickle.unregister_pickle_by_value(fp)
    assert got == {1: "same", 4: "same", 2: "same-1", 3: "same-1", 5: "same-2"}


def test_fingerprints(spark):
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame(spark, [(1, "A  b"), (2, "a B"), (3, None), (4, "")])).collect()}
    assert got[1] == got[2] != got[3] == got[4]
