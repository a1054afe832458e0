import re
import zlib

import numpy as np

from querent.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, fold string"


def test_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_the_text_of_learning_documents_matters(spark):
    rows = [(i, ("the cat and dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de", None, None) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    changed = [(i, t, "xx" if i in held else a, s, f) for i, t, a, s, f in rows]
    one, two = (sorted(langid.identify(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, changed))
    assert one == two and {r.lang_pred for r in one} == {"en", "de"}


def test_nulls_no_letters_and_nothing_to_learn(spark):
    rows = [(1, None, "en", "", ""), (2, "", "en", "", ""), (3, "123 !!", "en", "", ""), (None, "the cat", None, "", ""), (4, "the", None, "", ""), (4, "the", None, "", "")]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.lang_pred == "und" or r.lang_pred == "en" for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_document_frequencies_count_every_document(spark):
    texts = ["abc abc", "xbc", "é"] * 7
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    seen, n = langid.document_frequencies(df)
    want = np.zeros(langid.BUCKETS, int)
    for t in texts:
        want[langid.ngram_counts(t)[0]] += 1
    assert n == 21 and (seen == want).all()


def test_long_text_is_counted_whole(monkeypatch):
    text = "Ein Hund,  12 Katzen\n\n\nund 3 été ... " * 40 + "x"
    want = langid.ngram_counts(text)
    # plain sums: one of each n-gram of the letters and single gaps, padded at both ends
    codes = re.sub("[^a-z\xc0-\U0010ffff]+", " ", f" {text.lower()} ")
    assert want[1].sum() == sum(len(codes) - n + 1 for n in langid.NGRAMS)
    for size in (1, 2, 3, 7, 100, 1279):
        monkeypatch.setattr(langid, "_CHUNK", size)
        got = langid.ngram_counts(text)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all(), size


def test_every_language_is_learnt(spark):
    made = [(i, " ".join(chr(97 + (i // 12 * 7 + j) % 26) * 3 + chr(0x4E00 + i // 12) for j in range(8)), f"l{i // 12:03}", None, None) for i in range(12 * 230)]
    model = langid.train(spark.createDataFrame(made, SCHEMA), sample_per_lang=3)
    assert len(model.langs) == 230


def test_accepted_rows_keep_their_columns(spark):
    rows = [(1, None, "en", "a", ""), (1, "a good text of the day", "en", "b", ""), (None, "another text", "en", "c", ""), (None, None, "en", "d", ""), (2, "12 34", None, "e", "")]
    got = langid.accepted(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "score", "fold"] and sorted(r.score for r in got.collect()) == ["b", "c"]
    unlabelled = spark.createDataFrame([(a, b, None, d, e) for a, b, _, d, e in rows], SCHEMA)
    assert sorted(r.score for r in langid.accepted(unlabelled).collect()) == ["b", "c"]


def test_temperature_restores_overconfident_scores():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    truth = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.calibrated(logits * 4, truth) - 4) < 0.6
