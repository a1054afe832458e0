import re

import corpus_pipeline
from querent.llm import lines, secrets
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and then walks home again while the rain falls on every roof and nobody minds"


def corpus():
    key = "392c32d5b55f97ff33fc3fc853cf31109db4ef39"
    rows = [(k, f"{PROSE} item {chr(97 + k)} {' '.join(chr(97 + (k * 7 + j * j) % 26) * 3 for j in range(30))}\nAll rights reserved by us.", "en") for k in range(20)]
    rows += [(50 + k, rows[3][1].replace("quick", f"quick{chr(97 + k)}", 1) if k else rows[3][1], "en") for k in range(3)]
    rows += [(80, f"der hund und die katze laufen nach hause token = \"{key}\" und bellen laut", "de"), (81, "der hund und die katze sitzen im garten und warten", "de")]
    rows += [(90, None, "en"), (91, "", None), (92, "12345 !!!", "en"), (93, "word " * 5000, None), (80 + 20, rows[5][1], "en")]
    return [(d, t, a, "src0", len(t or "")) for d, t, a in rows]


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            got = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "language_id":
            want = [(d, t) for d, t in rows if t and re.search("[^\\W\\d_]", t)]
        elif name == "line_dedup":
            want = brute_lines(rows, lines.MIN_TEXTS)
            assert want != rows
        elif name == "near_duplicates":
            least = brute_components(dict(rows))
            want = [(d, t) for d, t in rows if least[d][1] == d]
            assert len(want) < len(rows)
        elif name == "secret_scan":
            want = [(d, re.sub("(?<=token = \")[0-9a-f]{40}", secrets.MASK, t)) for d, t in rows]
            assert want != rows
        if name == "best_fit_packing":
            check(out.collect(), dict(rows))
        else:
            assert got == sorted(want), name
            docs, rows = out, got


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 10
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "secret_scan", "best_fit_packing"]


def test_near_duplicates_of_five_words(spark, tmp_path):
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * k % 26)}" for k in range(200)]
    texts = {1: words[:50], 2: [*words[:25], "other", *words[26:50]], 3: words[:61], 4: words[:65], 10: words[100:180], 11: words[100:165], 12: words[100:162]}

    def linked(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        return 100 * len(x & y) >= 80 * len(x | y)

    least = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if linked(texts[a], texts[b]):
                low, high = sorted((least[a], least[b]))
                least = {d: low if c == high else c for d, c in least.items()}
    docs = spark.createDataFrame([(d, " ".join(w), "en", "src0", 0) for d, w in texts.items()], COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == {d for d, low in least.items() if d == low} and 2 not in got and 11 not in got


def test_rows_are_told_apart_by_doc_id_and_text(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (1, "other words that nobody else has"), (1, "other words that nobody else has"), (7, long), (7, "a text of its own here"), (None, long), (None, "nobody knows me at all"), (None, "nobody knows me at all"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "src0", k) for k, (d, t) in enumerate(rows)], COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, long), (1, "other words that nobody else has"), (7, "a text of its own here"), (None, "nobody knows me at all"), (None, None)], key=repr)
