import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import resampling as r

DOCS, TARGET = "doc_id long, text string, score long, a string", "item_id long, text string"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{x} {y}" for x, y in zip(words, words[1:])]


def brute(docs, target, percent=25, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(x for _, x in target)
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)}
    rows = []
    for d, text in docs:
        words, fs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in rows if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in rows), key=repr)


def check(spark, docs, target, **more):
    df = spark.createDataFrame([(d, t, 5, "clash") for d, t in docs], DOCS).repartition(5)
    got = r.resampled(df, spark.createDataFrame(target, TARGET), **more)
    assert sorted(map(tuple, got.drop("n_words").collect()), key=repr) == brute(docs, target)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(rng.choice(["Alpha", "beta9", "Éa", "x", "漢字", "don't", "a_b", "zeta" * 30], int(rng.integers(0, 60))))) for i in range(n)]


@pytest.mark.parametrize("few", [0, 16, 4096])
def test_matches_brute_force(spark, few):
    check(spark, texts(400, 1), texts(20, 2), few=few)


def test_nulls_repeats_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(None, long), (None, None), (3, ""), (4, "!!"), (5, long), (5, long), (5, long + " more"), *[(9, long)] * 12, (None, long)]
    for few in (0, 4096):
        check(spark, docs, [(1, None), (2, "w1 w2")], few=few)
    check(spark, docs, [])
    check(spark, [(1, "few words")], [(1, "few")])
    assert r.resampled(spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGET)).count() == 0


def test_long_texts_in_portions(spark, monkeypatch):
    monkeypatch.setattr(r, "PORTION", 50)
    docs = texts(40, 3)
    for k, held in enumerate(r.portions([t for _, t in docs])):
        assert held
    owner, n = np.zeros(0, int), Counter()
    for held in r.portions([t for _, t in docs]):
        o, b, _ = r.hashed(held)
        n.update(zip(o.tolist(), b.tolist()))
    assert n == Counter((k, zlib.crc32(f.encode()) % 10000) for k, (_, t) in enumerate(docs) for f in features(t)[1])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=64))
def test_crc_of_joined_texts(a, b):
    got = r.crc_joined(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
    assert got[0] == zlib.crc32(a + b)


def test_selection_discards_a_quarter_each_round(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = [(int(x), int(y)) for x, y in zip(rng.integers(-50, 50, 5000), rng.integers(0, 10**6, 5000))]
    df = spark.createDataFrame(keys, "a long, b long").repartition(7).sortWithinPartitions("a", "b").cache()
    left, sides = [], r._sides
    monkeypatch.setattr(r, "_sides", lambda *x: left.append(sides(*x)) or left[-1])
    for k in (1, 700, 2500, 4999):  # the rest is read at once
        assert r.cutoff(df, k, few=300) == sorted(keys)[k - 1]
    for k in (1, 1250, 5000):
        left.clear()
        assert r.cutoff(df, k, few=0) == sorted(keys)[k - 1]
        sizes = [sum(x.under + x.same + x.over for x in s) for s in left]
        assert all(b <= 0.75 * a + 1 for a, b in zip(sizes[1:], sizes[2:]))
