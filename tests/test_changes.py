"""Changes between snapshots of an index, entries of older writers, alerts that last, and checks that fail themselves."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from querent.operators import evaluation, guardrails, ingestion, lexical_index

SNAP = "chunk_id string, document_id string, entry_hash string"


def changes(spark, before, after, **more):
    got = ingestion.changes(spark.createDataFrame(before, SNAP), spark.createDataFrame(after, SNAP), **more)
    return Counter(tuple(r) for r in got.collect())


def test_changes_between_snapshots(spark):
    before = [("a:0", "a", "1"), ("a:1", "a", "2"), ("a:2", "a", "3"), ("b:0", "b", "4"), (None, "n", "5"), ("d:0", "d", "7"), ("d:0", "d", "8")]
    after = [("a:0", "a", "1"), ("a:1", "a", "x"), ("c:0", "c", "6"), (None, "n", "5"), ("d:0", "d", "8")]
    want = Counter([("a:0", "unchanged"), ("a:1", "changed"), ("a:2", "removed"), ("c:0", "added"), (None, "unchanged"), ("d:0", "unchanged")])
    assert changes(spark, before, after) == want  # b is not in the batch, so nothing is said of it
    assert changes(spark, before, after, whole=True) == want + Counter([("b:0", "removed")])
    assert not changes(spark, [], []) and set(changes(spark, [], after).values()) == {1}
    assert changes(spark, before, before)["a:0", "unchanged"] == 1


def test_entries_and_what_older_writers_left(spark):
    chunks = spark.createDataFrame([("c1", "d1", "text", ["A", "B"], None), ("c2", "d2", None, None, "root")], "chunk_id string, document_id string, text string, heading_path array<string>, lineage_root string")
    rows = {r.chunk_id: r for r in ingestion.payload(chunks, "v9").collect()}
    assert list(rows["c1"].asDict()) == ingestion.PAYLOAD and len(ingestion.PAYLOAD) == 17
    assert (rows["c1"].lineage_root, rows["c2"].lineage_root, rows["c2"].heading_path, rows["c1"].embedding_version, rows["c1"].authority) == ("d1", "root", [], "v9", None)
    old = spark.createDataFrame([("c1", "d1", ""), (None, None, None)], "chunk_id string, document_id string, lineage_root string").withColumn("more", F.lit(1))
    a, b = sorted((r.asDict() for r in ingestion.payload_fields(old).collect()), key=lambda r: -len(r["chunk_id"]))
    assert a == {"chunk_id": "c1", "document_id": "d1", "document_version": "unknown", "text": "", "parent_text": None, "heading_path": [], "acl_hash": "public", "tenant_id": None, "authority": 0.5, "lineage_root": "d1", "embedding_version": None}
    assert b["chunk_id"] == "" and b["lineage_root"] == ""
    one, two = ingestion.payload(chunks, "v9"), ingestion.payload(chunks.withColumn("heading_path", F.array(F.lit("A"), F.lit("C"))), "v9")
    assert {r.entry_hash for r in ingestion.entry_hash(one).collect()} == {r.entry_hash for r in ingestion.entry_hash(ingestion.payload(chunks, "v9")).collect()}
    assert not {r.entry_hash for r in ingestion.entry_hash(one).collect()} & {r.entry_hash for r in ingestion.entry_hash(two).collect()}


def test_only_changes_reach_the_index(spark, tmp_path):
    def chunks(rows):
        return spark.createDataFrame([(f"{d}:{k}", d, "t", "public", line) for d, lines in rows.items() for k, line in enumerate(lines)], "chunk_id string, document_id string, tenant_id string, acl_hash string, text string")

    snap = lambda rows: ingestion.entry_hash(ingestion.payload(rows, "v1"))
    first, later = chunks({"a": ["one", "two", "three"], "b": ["four"]}), chunks({"a": ["one", "2"], "b": ["four"], "c": ["five"]})
    index = lexical_index.upserted(lexical_index.create(spark, str(tmp_path / "i"), 2, "string"), first)
    same = lexical_index.synced(index, first, ingestion.changes(snap(first), snap(first)))
    assert same.version == index.version
    index = lexical_index.synced(index, later, ingestion.changes(snap(first), snap(later)))
    live = {(r.chunk_id, r.term) for r in lexical_index.live(index).where("term <> ''").collect()}
    assert live == {("a:0", "one"), ("a:1", "2"), ("b:0", "four"), ("c:0", "five")} and index.documents == 4
    assert index.state["segments"][-1]["rows"] == 4  # a:1 and c:0, with their rows of the empty term


def test_alerts_that_last(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for minute in range(60):
        slow = 10 <= minute < 35 or minute == 50
        rows += [("n", start + datetime.timedelta(minutes=minute, seconds=30), 40.0)] * 3 + [("n", start + datetime.timedelta(minutes=minute, seconds=40), 900.0)] * (3 if slow else 0)
    rows += [("n", None, 9000.0), ("n", start, None), ("m", start, 9000.0)]
    df = spark.createDataFrame(rows, "node string, ts timestamp_ntz, value double")
    got = evaluation.quantile_alerts(df, "value", "ts", ["node"], 0.95, 300.0, step_s=60, range_s=300, for_s=600).collect()
    # evaluations from minute 11 to 39 see slow rows of the last five minutes; minute 51 to 55 do not last
    assert [(r.node, r.starts, r.fires_at, r.ends) for r in got] == [("n", start + datetime.timedelta(minutes=11), start + datetime.timedelta(minutes=21), start + datetime.timedelta(minutes=39))]
    assert evaluation.quantile_alerts(df.limit(0), "value", "ts", ["node"], 0.95, 300.0, 60, 300, 600).count() == 0


def test_a_check_that_fails_blocks_its_row_alone(spark):
    def odd(text):
        return "seven" if 42 // int(text) == 7 else None

    df = spark.createDataFrame([("6",), ("0",), ("x",), ("5",), (None,)], "t string")
    got = {r.t: (r.verdict, r.reason, r.fired) for r in guardrails.chain(df, "t", [("odd", guardrails.guarded(odd), None)]).collect()}
    assert got == {"6": ("block", "seven", ["odd"]), "0": ("block", "guardrail_error", ["odd"]), "x": ("block", "guardrail_error", ["odd"]), "5": ("allow", None, []), None: ("allow", None, [])}
    masked = guardrails.chain(df, "t", [("odd", guardrails.guarded(odd), lambda t: F.lit("masked")), ("later", lambda t: F.when(t == "masked", "seen"), None)])
    got = {r.t: (r.verdict, r.reason, r.checked_text) for r in masked.collect()}
    assert got["0"] == ("block", "guardrail_error", "0") and got["6"] == ("block", "seen", "masked") and got["5"] == ("allow", None, "5")


def test_scorecards_as_text(spark):
    card = spark.createDataFrame([("b", 0.5, 4, None, True), ("a", 1.0, 3, 0.25, False)], "metric_id string, mean double, n long, pass_rate double, judged boolean")
    (row,) = evaluation.card_json(card, "golden").collect()
    assert row.json.index('"a"') < row.json.index('"b"') and row.json.startswith('{"dataset_id":"golden"')
    back = evaluation.card_of_json(spark.createDataFrame([row]))
    assert sorted(tuple(r) for r in back.collect()) == [("golden", "a", 1.0, 3, 0.25, False), ("golden", "b", 0.5, 4, None, True)]


def test_merged_weights(spark):
    from querent.operators import serving

    rows = [(1, "a", 0.9, 0.5, "x"), (1, "b", 0.5, 0.9, "y"), (2, "a", 0.9, 0.2, "x"), (2, "b", 0.4, 0.9, "y"), (3, "a", 0.7, None, None)]
    got = serving.merged_weights(spark.createDataFrame(rows, "request_id long, adapter_id string, coverage double, score double, answer string")).collect()
    assert {r.request_id: (r.adapter_id, r.score) for r in got} == {1: ("b", 0.45), 2: ("b", 0.36), 3: ("a", None)}
