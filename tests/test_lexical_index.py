"""The persistent lexical index against one that is built anew, and against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import lexical_index as li
from querent.operators import retrieval
from querent.plans.retrieval import indexed_scores
from querent.sources import versions

CHUNK = "chunk_id long, tenant_id string, acl_hash string, text string, at long"
QUERIES = "query_id long, query_text string, tenant_id string, acl_hashes array<string>"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "t", "public", t, n) for n, (i, t) in enumerate(rows)], CHUNK)


def facts(index):
    """Everything an index holds, as plain values."""
    rows = [tuple(r) for r in li.live(index).select("chunk_id", "term", "tf", "length", "n_words").collect()]
    return sorted(rows), sorted(map(tuple, li.frequencies(index).collect())), index.documents, index.tokens


def plain(docs):
    rows, df = [], Counter()
    tokens = {i: re.findall(r"[a-z0-9][a-z0-9\-_.]*", (t or "").lower()) for i, t in docs.items()}
    for i, ts in tokens.items():
        df.update(set(ts))
        rows += [(i, w, n, len(ts), len(set(ts))) for w, n in [*Counter(ts).items(), ("", 1)]]
    return sorted(rows), sorted(df.items()), len(docs), sum(map(len, tokens.values()))


def test_batches_equal_a_rebuild(spark, tmp_path):
    docs = {i: f"alpha beta w{i % 5} w{i} " + "common " * (i % 3) for i in range(40)} | {50: None, 51: "", 52: "!!"}
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 4), chunks(spark, docs.items()))
    assert facts(index) == plain(docs)
    steps = [
        ("up", {3: "beta only", 7: "new words", 60: "w3 more", 50: "now with text"}),
        ("del", [7, 8, 999, 8]),
        ("up", {8: "back again", 3: "alpha third time"}),
        ("up", {}),
        ("del", [60, 51]),
    ]
    for what, batch in steps:
        if what == "up":
            docs |= batch
            index = li.upserted(index, chunks(spark, batch.items()))
        else:
            docs = {i: t for i, t in docs.items() if i not in batch}
            index = li.deleted(index, spark.createDataFrame([(i,) for i in batch], "chunk_id long"))
        assert facts(index) == plain(docs)
    before = li.reopened(spark, index.folder)
    assert facts(before) == plain(docs) and before.version == index.version
    whole = li.compacted(index)
    assert len(whole.state["segments"]) == 1 and not whole.state["marks"] and facts(whole) == plain(docs)
    assert facts(before) == plain(docs)  # a reader of the version before is not disturbed
    again = li.upserted(whole, chunks(spark, [(3, "after compaction")]))
    assert facts(again) == plain(docs | {3: "after compaction"})
    everything = li.deleted(again, spark.createDataFrame([(i,) for i in docs], "chunk_id long"))
    assert facts(everything) == plain({})


def test_opened_in_another_session(spark, tmp_path):
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 3), chunks(spark, [(1, "one two"), (2, "two")]))
    for s in [*index.state["segments"], *index.state["marks"], *index.state["terms"]]:
        spark.sql(f"DROP TABLE {s['name']}")  # external: the files stay
    assert facts(li.reopened(spark, index.folder)) == plain({1: "one two", 2: "two"})


def test_repeats_nulls_and_headings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "public", "old", 1), (1, "t", "public", "new", 2), (None, "t", "public", "lost", 3), (2, "t", "public", "x y", 1)], CHUNK)
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 2), rows, order="at")
    assert facts(index) == plain({1: "new", 2: "x y"}) and index.state["offered"] == 4
    index = li.upserted(index, rows.where("chunk_id = 2").withColumn("heading_path", F.array(F.lit("Head"), F.lit("Line"))))
    assert facts(index) == plain({1: "new", 2: "head line x y"})
    empty = li.create(spark, str(tmp_path / "b"), 2)
    q = spark.createDataFrame([(1, "x y", "t", [])], QUERIES)
    assert facts(empty) == plain({}) and li.postings(empty, q).count() == 0
    assert facts(li.deleted(empty, spark.createDataFrame([(1,)], "chunk_id long"))) == plain({})
    with pytest.raises(ValueError, match="no index"):
        li.reopened(spark, str(tmp_path / "none"))


def test_of_two_writers_one_starts_again(spark, tmp_path):
    index = li.create(spark, str(tmp_path / "a"), 2)
    first = li.upserted(index, chunks(spark, [(1, "mine")]))
    with pytest.raises(versions.Conflict):
        li.upserted(index, chunks(spark, [(2, "theirs")]))
    assert facts(li.reopened(spark, index.folder)) == plain({1: "mine"})
    again = li.upserted(first, chunks(spark, [(2, "theirs")]))
    assert facts(again) == plain({1: "mine", 2: "theirs"})


@pytest.mark.parametrize("sent", [li.SENT, 0])
def test_history_is_not_shuffled(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(li, "SENT", sent)
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 4), chunks(spark, [(i, f"w{i} common") for i in range(200)]))
    index = li.upserted(index, chunks(spark, [(i, f"v{i} common") for i in range(20)]))
    index = li.deleted(index, spark.createDataFrame([(5,)], "chunk_id long"))
    queries = spark.createDataFrame([(1, "common w50 v5 v6", "t", [])], QUERIES)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = li.postings(index, queries)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    depth = lambda line: re.search(r"[A-Z(*]", line).start()
    segments = [k for k, line in enumerate(plan) if "FileScan" in line and "querent_segment" in line]
    assert len(segments) == 2
    for k in segments:
        above, at = [], depth(plan[k])
        for line in reversed(plan[:k]):
            if line.strip() and depth(line) < at:
                above.append(line)
                at = depth(line)
        # not before the query's terms have cut the rows, nor before what was replaced is taken out
        joins = [n for n, line in enumerate(above) if "Join" in line]
        assert not any("Exchange" in line for line in above[: max(joins) + 1]), "\n".join(plan)
    assert {(r.chunk_id, r.term) for r in li.postings(index, queries).collect() if r.term != "common"} == {(50, "w50"), (6, "v6")}


def test_compaction_is_due_by_size(spark, tmp_path):
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 2), chunks(spark, [(i, "a b c") for i in range(30)]))
    assert not li.due(index)
    index = li.upserted(index, chunks(spark, [(i, "d e f") for i in range(5)]))
    assert not li.due(index)
    index = li.upserted(index, chunks(spark, [(i, "g h i") for i in range(12)]))
    assert li.due(index) and not li.due(li.compacted(index))


def test_items_meet_the_documents_that_hold_them(spark, monkeypatch):
    docs = [(1, "say alpha betamax now"), (2, "ALPHA beta gamma, delta"), (3, "one"), (4, None), (5, "x one two three y"), (6, "xone two threey"), (7, ""), (8, "a.b -c d")]
    items = [(10, "alpha beta"), (11, "one"), (12, "one two three"), (13, ""), (14, None), (15, "beta gamma, d"), (16, "nowhere at all here"), (17, "e"), (18, ".b -c d"), (11, "one")]
    want = sorted((q, d) for q, item in items for d, t in docs if item and t is not None and item in t)
    q, d = spark.createDataFrame(items, "query_id long, item string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, retrieval.holders(q, d).collect())) == want
    monkeypatch.setattr(retrieval, "SHORT_ROWS", 0)
    assert sorted(map(tuple, retrieval.holders(q, d).collect())) == want


def test_a_segment_has_a_row_for_each_chunk_and_its_words_are_not_dealt_out(spark, tmp_path):
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 4), chunks(spark, [(i, "alpha beta gamma alpha " * 5 + f"w{i}") for i in range(50)]))
    index = li.upserted(index, chunks(spark, [(3, "beta"), (60, None)]))
    index = li.deleted(index, spark.createDataFrame([(7,)], "chunk_id long"))
    assert [spark.table(s["name"]).count() for s in index.state["segments"]] == [50, 2] and [s["rows"] for s in index.state["segments"]] == [250, 3]
    rows = li.counted(index, ["alpha", "beta", "nowhere", "w9"])
    assert "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_id: (r.length, r.n_words, r.terms, r.tfs) for r in rows.collect()}
    assert len(got) == 50 and got[9] == (21, 4, [0, 1, 3], [10, 5, 1]) and got[3] == (1, 1, [1], [1]) and got[60] == (0, 0, [], [])
    assert li.document_frequencies(index, ["alpha", "beta", "nowhere", "w9"]).tolist() == [48, 49, 0, 1]
    assert li.document_frequencies(index, []).tolist() == [] and {tuple(r.terms) for r in li.counted(index, []).collect()} == {()}


@pytest.mark.parametrize("counted", [li.COUNTED, 7])
def test_blocks_over_an_index_equal_all_pairs(spark, tmp_path, monkeypatch, counted):
    monkeypatch.setattr(li, "COUNTED", counted)
    rows = [(i, f"t{i % 2}", ["public", "acl-eng", "acl-finance", None][i % 4], None if i == 11 else f"w{i % 7} w{i % 5} " * (i % 4) + f"v{i % 9} common", 0) for i in range(120)]
    index = li.upserted(li.create(spark, str(tmp_path / "a"), 3), spark.createDataFrame(rows, CHUNK))
    index = li.upserted(index, spark.createDataFrame([(5, "t1", "public", "w1 w2 w3", 0), (200, "t0", "public", "common common v3", 0)], CHUNK))
    index = li.deleted(index, spark.createDataFrame([(i,) for i in range(60, 70)], "chunk_id long"))
    asking = [(1, "common w1 w1", "t0", ["acl-eng"]), (2, "v3 w2 nowhere", "t1", []), (3, "!!", "t0", []), (4, None, "t0", []), (5, "w3", None, ["acl-eng"]), (6, "w4", "t1", None)]
    for more in ([], [(2, "v3", "t1", [])]):  # two queries of one id are scored by all pairs
        queries = spark.createDataFrame(asking + more, QUERIES)
        want = retrieval.bm25_scores(queries, li.postings(index, queries), li.statistics(index))
        a, b = (sorted(map(tuple, retrieval.top_k(s, 24).select("query_id", "chunk_id", "rank", "score").collect())) for s in (want, indexed_scores(queries, index)))
        assert a == b and {r[0] for r in a} == {1, 2}
    queries = spark.createDataFrame(asking, QUERIES)
    assert indexed_scores(queries, li.create(spark, str(tmp_path / "b"), 2)).count() == 0
    assert indexed_scores(queries.where("query_id = 3"), index).count() == 0


def test_words_are_those_of_the_pattern_for_every_character(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(" ".join(f"a{c}B-{c}.7" for c in letters[k : k + 64]),) for k in range(0, len(letters), 64)]
    rows += [("",), ("--",), ("-.a-._b.. _ _x -",), ("x\x00y\u2028z\tA-B_C",), ("\u0130\u212a\u0130x",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.tokens(F.col("t")).alias("words")).toArrow().to_pylist()
    assert len(got) == len(rows)
    for r in got:
        assert {w.decode(): n for w, n in text.lexical_counts(r["t"].encode()).items()} == Counter(r["words"])


def test_an_index_of_another_layout_is_refused(spark, tmp_path):
    index = li.create(spark, str(tmp_path / "a"), 2)
    versions.commit(spark, index.folder, index.version, {k: v for k, v in index.state.items() if k != "layout"})
    with pytest.raises(ValueError, match="layout 1"):
        li.reopened(spark, index.folder)
