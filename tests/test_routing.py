"""The parametric route and what goes on to the evidence plan."""

from querent.operators import routing as rt

Q, S, A = "query_id long, query_text string", "query_id long, adapter_id string, coverage double", "query_id long, adapter_id string, score double, answer string"

GOOD = "Backups are kept for thirty days in the Oslo region. Auditors may read them on request."


def test_only_what_declines_reaches_the_evidence_plan(spark):
    questions = spark.createDataFrame([(k, f"question {k}") for k in range(1, 8)] + [(1, "question 1")], Q)
    selected = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.7), (3, "a", 0.9), (4, "a", 0.9), (5, "a", 0.9), (5, "b", 0.8), (7, "a", 0.9)], S)
    answers = spark.createDataFrame([(1, "a", 0.9, GOOD), (2, "a", 0.3, GOOD), (3, "a", 0.9, "  "), (4, "a", 0.9, "Backups are not kept for thirty days in the Oslo region."), (5, "a", 0.4, "unsure"), (5, "b", 0.8, GOOD), (7, "a", 0.9, None)], A)
    seen = {}

    def retrieve(rows):
        seen["retrieve"] = sorted(r.query_id for r in rows.collect())
        lines = [(k, "E1", 0, "Backups are kept for thirty days in the Oslo region.") for k in seen["retrieve"]]
        return spark.createDataFrame(lines, "query_id long, marker string, place int, text string")

    def by_evidence(rows):
        seen["evidence"] = sorted(r.query_id for r in rows.collect())
        return spark.createDataFrame([(k, f"evidence {k}") for k in seen["evidence"]], "query_id long, answer string")

    got = {r.query_id: r for r in rt.routed(questions, selected, answers, retrieve, by_evidence, suffices=lambda q, g: q.where("query_id = 5")).collect()}
    assert seen == {"retrieve": [1, 4, 5], "evidence": [2, 3, 4, 6, 7]}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: rt.UNSURE, 3: rt.UNSURE, 4: rt.CONTRADICTED, 5: None, 6: rt.NO_ADAPTER, 7: rt.UNSURE}
    assert {k: r.route for k, r in got.items() if r.route == "parametric"} == {1: "parametric", 5: "parametric"} and (got[1].basis, got[5].basis) == ("parametric", "hybrid")
    assert got[1].answer == "Backups are kept for thirty days in the Oslo region. Auditors may read them on request. [unsourced]"
    assert [(c.marker, c.score) for c in got[1].citations] == [("E1", 1.0)]
    # the second adapter answers where the first is unsure and it is surer; coverage is the best one's
    assert got[5].confidence == 0.85 and got[1].confidence == 0.9
    assert got[6].answer == "evidence 6" and got[6].confidence is None and got[6].citations == []


def test_no_questions(spark):
    none = spark.createDataFrame([], Q)
    rows = rt.routed(none, spark.createDataFrame([], S), spark.createDataFrame([], A), lambda q: spark.createDataFrame([], "query_id long, marker string, place int, text string"), lambda q: q.withColumnRenamed("query_text", "answer"))
    assert rows.count() == 0


def test_marks_come_once_and_in_place(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("One. Two. One.", ["One.", "Two."]), ("x", ["absent"]), ("x", [])], "a string, c array<string>")
    got = [r[0] for r in df.select(rt._marked(F.col("a"), F.col("c"))).collect()]
    assert got == ["One. [unsourced] Two. [unsourced] One.", "x", "x"]
