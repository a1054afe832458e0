import random

import numpy as np
import pytest

from querent.llm import jaccard
from querent.llm.components import components

SCHEMA = "doc_id long, text string, node string, first string, region string"


def brute(texts):
    sets = {}
    for d, t in texts.items():
        words = [w.decode() for w in (t or "").encode().translate(jaccard._LOWER).split()]
        sets[d] = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
    comp = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in texts}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 90]))] for _ in range(12)]
    texts = {}
    for d in range(n):
        words = list(rng.choice(bases[:3] if d % 3 == 0 else bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = words + passage
        if rng.random() < 0.3:
            words = [rng.choice(vocab) for _ in range(60)] + passage
        texts[d * 3 + 1] = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
    return texts | {900: None, 901: "", 902: " \t\n", 903: "one two", 904: "ONE  two", 905: "x" * 5000, 906: "a b " * 4000, 907: "a b " * 4001}


@pytest.mark.parametrize(("frequent", "region_docs", "pivots", "share"), [(16, 5000, 128, 4), (2, 5000, 128, 1), (3, 4, 5, 2)])
def test_components_match_brute_force(spark, monkeypatch, frequent, region_docs, pivots, share):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    texts = corpus(frequent)
    df = spark.createDataFrame([(d, t, "n", "f", "r") for d, t in texts.items()], SCHEMA)
    rows = jaccard.jaccard_components(df, frequent=frequent, region_docs=region_docs, share=share).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts) and len(rows) == len(texts)


def test_empty_repeated_and_null_ids(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e", "", "", "")] * 2 + [(5, "A B C D E", "", "", ""), (None, "q r s t u", "", "", "")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (5, 5), (7, 5), (7, 5)]


def test_region_join_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 500, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.25, rng.integers(0, 500, 60), base)) for _ in range(40)]
        label = list(range(40))
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    x, y = label[i], label[j]
                    label = [min(x, y) if c in (x, y) else c for c in label]
        assert jaccard.join_region(sets, 85, 100).tolist() == label


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(10, 60)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(10, 60)]}
