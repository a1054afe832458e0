import hashlib
import random

import pytest

from querent.llm.substring import SubstringIndex, substring_deduplicated, substring_digests

SCHEMA = "doc_id long, text string, version string, print string, whole string"


def brute(texts, width):
    """texts: (doc_id, text) pairs."""
    words = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in texts]
    first = {}
    for d, ws in words:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1):
            if d is not None and first[tuple(ws[k : k + width])] < d:
                gone |= set(range(k, k + width))
        out.append((d, " ".join(w for k, w in enumerate(ws) if k not in gone), len(ws), len(gone)))
    return sorted(out, key=str)


def corpus(seed, width):
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(60)] + ["a\xa0b", "x\x1cy"]
    passages = [[rng.choice(vocab) for _ in range(width + rng.randrange(-2, 25))] for _ in range(6)]
    rows = []
    for d in range(90):
        ws = [rng.choice(vocab) for _ in range(rng.choice([0, 3, width - 1, width, 80]))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)
        rows.append((rng.randrange(1000) if rng.random() < 0.05 else d * 7 % 90 + 1000, rng.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(rng.choice(rows)[0] + 5000 + k, rng.choice(rows)[1]) for k in range(12)]
    return [*rows, (1, None), (2, ""), (None, rows[5][1]), (None, None), rows[3], (3, "same " * 200), (4, "same " * 200), (5, "same " * 60)]


@pytest.mark.parametrize(("width", "gram", "batches"), [(50, 25, 3), (12, 5, 1), (7, 4, 5)])
def test_matches_brute_force(spark, width, gram, batches):
    rows = corpus(width, width)
    df = spark.createDataFrame([(d, t, "v", "p", "w") for d, t in rows], SCHEMA)
    got = substring_deduplicated(df, batches, width, gram).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_batches_may_come_one_by_one(spark):
    text = " ".join(f"t{k}" for k in range(70))
    docs = spark.createDataFrame([(1, text), (2, "new " + text), (3, text + " end")], "doc_id long, text string")
    index = SubstringIndex(spark)
    for k in (1, 2, 3):
        index.add(docs.where(f"doc_id = {k}"))
    assert len(index.runs) == 2  # two runs were compacted
    assert {r.doc_id: r.text for r in index.cleaned(docs).collect()} == {1: text, 2: "new", 3: "end"}


def test_digests_and_empty_table(spark):
    assert substring_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    r = substring_digests(spark.createDataFrame([(1, "a  b\nc", "", "", "")], SCHEMA)).first()
    assert (r.n_words, r.n_removed, r.kept_sha256) == (3, 0, hashlib.sha256(b"a b c").hexdigest())
