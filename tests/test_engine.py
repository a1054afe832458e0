"""Behaviour of operators that SQL cannot express, and of edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import context, evidence, filters, fusion, grounding, guardrails, ingestion, intelligence, memory, parametric, retrieval


def test_token_estimate_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("",), ("a" * 10,), ("a" * 6,), ("!",), ("漢字" * 7,)], "t string")
    got = [r[0] for r in rows.select(text.token_estimate(F.col("t"))).collect()]
    assert got == [0, 2, 2, 1, 5] and got == [ingestion.tokens_in(t) for t in ("", "a" * 10, "a" * 6, "!", "漢字" * 7)]


def test_filters_refuse_what_they_do_not_know(spark):
    for bad in ({"a": {"$near": 1}}, {"$xor": []}, {"a": {"$gt": None}}):
        with pytest.raises(filters.FilterError):
            filters.predicate(bad)
    df = spark.createDataFrame([(1, "t1", "public"), (2, "t1", "secret"), (3, "t2", "public")], "id long, tenant_id string, acl_hash string")
    assert [r.id for r in df.where(filters.scoped({"tenant_id": {"$exists": True}}, "t1", [])).collect()] == [1]
    assert df.where(filters.predicate({})).count() == 3


def test_redaction_keeps_the_right_most_of_overlapping_spans(spark):
    rows = [("a@b.co and 123-45-6789",), ("call 555-123-4567 now",), (None,), ("4242 4242 4242 4242",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(guardrails.redactor()(F.col("t"))).collect()]
    assert got == ["[REDACTED:EMAIL] and [REDACTED:SSN]", "call [REDACTED:PHONE] now", None, "[REDACTED:CARD]"]


def test_leader_groups(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    pool = [("q", 1, 0.9, 0.3, 1, base), ("q", 2, 0.8, 0.9, 1, base + " lambda"), ("q", 3, 0.7, 0.5, 1, "other words here"), ("q", 4, 0.6, 0.5, 4, base.upper() + "!"), ("r", 5, 0.1, 0.1, 5, "")]
    got = {(r.query_id, r.group_no): r for r in evidence.leader_groups(spark.createDataFrame(pool, "query_id string, chunk_id long, effective_score double, authority double, lineage_root long, text string")).collect()}
    assert got["q", 1].members == [1, 2, 4] and got["q", 1].representative == 2 and got["q", 1].marker == "E1"
    assert got["q", 2].members == [3] and got["q", 1].independent and not got["q", 2].independent and got["r", 1].members == [5]


def test_packing_stays_in_budget_and_drops_what_does_not_fit(spark):
    rows = [("q", 1, 50, 0.9, 1.0, 0.5, ["a", "b"], ["a"], 2), ("q", 2, 500, 0.99, 1.0, 0.5, ["c"], ["b"], 2), ("q", 3, 40, 0.8, 1.0, 0.5, ["a", "b"], ["a"], 2), ("q", 4, 30, 0.3, 1.0, 0.5, ["d"], ["b"], 2)]
    schema = "query_id string, group_no int, tokens long, score double, authority double, freshness double, words array<string>, found array<string>, n_aspects int"
    got = {r.group_no: r for r in evidence.pack_evidence(spark.createDataFrame(rows, schema), 120).collect()}
    assert sum(r.tokens for r in got.values() if not r.dropped) <= 120 and got[2].dropped and got[2].place == -1
    assert got[1].coverage == 1.0 and {got[1].redundancy, got[3].redundancy} == {0.0, 1.0}


def test_lineage_roots_of_chains_and_cycles(spark):
    edges = [(k, k - 1) for k in range(2, 40)] + [(101, 102), (102, 103), (103, 101), (104, 103)]
    got = dict(evidence.lineage_roots(spark.createDataFrame(edges, "child long, parent long")).collect())
    assert all(got[k] == 1 for k in range(2, 40)) and {k: got[k] for k in (101, 102, 103, 104)} == {101: 101, 102: 102, 103: 103, 104: 103}
    got = dict(evidence.lineage_roots(spark.createDataFrame([(9, 4), (4, 3), (3, 5), (5, 4), (7, 7), (8, 7)], "child long, parent long")).collect())
    assert got == {9: 4, 4: 4, 3: 3, 5: 5, 7: 7, 8: 7}
    assert evidence.lineage_roots(spark.createDataFrame([], "child long, parent long")).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 12), st.integers(0, 12), min_size=1))
def test_lineage_roots_match_the_walk(spark, parent):
    def root(node):
        seen = set()
        while node not in seen and node in parent:
            seen.add(node)
            node = parent[node]
        return node

    got = dict(evidence.lineage_roots(spark.createDataFrame(list(parent.items()), "child long, parent long")).collect())
    assert got == {k: root(k) for k in parent}


def test_children_of(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "child long, parent long")
    got = evidence.children_of(edges, spark.createDataFrame([(1,), (1,), (9,)], "node long")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3)]


def test_claims_take_markers_back(spark):
    df = spark.createDataFrame([("a", "Records are kept long. [E1] They may be deleted later? Short. [E2][E3]")], "query_id string, answer string")
    got = [(r.text, r.markers) for r in grounding.claims(df).orderBy("n").collect()]
    assert got == [("Records are kept long. [E1]", ["E1"]), ("They may be deleted later?", []), ("Short. [E2][E3]", ["E2", "E3"])]


def test_verification_prefers_cited_groups(spark):
    claims = spark.createDataFrame([("q", 0, "the retention period is sixty days", ["E2"]), ("q", 1, "what now?", [])], "query_id string, n int, text string, markers array<string>")
    groups = spark.createDataFrame([("q", "E1", 0, "retention period sixty days"), ("q", "E2", 1, "nothing alike")], "query_id string, marker string, place int, text string")
    (r,) = grounding.verified(claims, groups).collect()
    assert r.score == 0.0 and not r.entailed and r.marker is None


def test_stance(spark):
    rows = [("records are retained for 60 days", "records are retained for 30 days", "contradicts"), ("records are retained", "records are not retained", "contradicts"), ("records are retained", "records are retained here", "supports"), ("records are retained", "cats sleep", None)]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.want == r.got for r in df.select("want", fusion.stance(fusion.stance_parts(F.col("a")), fusion.stance_parts(F.col("b"))).alias("got")).collect())


def test_isotonic_fit_is_monotone_and_pools_violators(spark):
    rng = np.random.default_rng(2)
    rows = [("m", float(x), int(rng.random() < x)) for x in rng.random(400)] + [("one", 0.5, 1)]
    knots = fusion.isotonic_fit(spark.createDataFrame(rows, "model string, p double, y int"), "model", "p", "y").orderBy("model", "k").collect()
    y = [r.y for r in knots if r.model == "m"]
    assert y == sorted(y) and len(y) < 100 and [(r.x, r.y) for r in knots if r.model == "one"] == [(0.5, 1.0)]
    small = spark.createDataFrame([("m", 0.1, 1), ("m", 0.2, 0), ("m", 0.3, 1)], "model string, p double, y int")
    got = fusion.isotonic_fit(small, "model", "p", "y").orderBy("k").collect()
    assert [(round(r.x, 4), r.y) for r in got] == [(0.15, 0.5), (0.3, 1.0)]


def test_markdown(spark):
    raw = "intro line\nmore\n# One\n```\ncode # not a heading\n\n```\n## Two\n- item\n> said\n| a | b |\n|---|---|\n| 1 | 2 |\n4.2 Keep it.\n# Three\n```\nopen"
    got = [(r.kind, r.text, r.heading_path) for r in ingestion.markdown_blocks(spark.createDataFrame([(1, raw)], "doc_id long, text string")).orderBy("block_no").collect()]
    assert got == [
        ("paragraph", "intro line more", []), ("heading", "One", []), ("code", "code # not a heading\n", ["One"]), ("heading", "Two", ["One"]), ("list_item", "item", ["One", "Two"]), ("quote", "said", ["One", "Two"]),
        ("table_header", "| a | b |", ["One", "Two"]), ("table_header", "| 1 | 2 |", ["One", "Two"]), ("clause", "4.2 Keep it.", ["One", "Two"]), ("heading", "Three", []), ("code", "open", ["Three"]),
    ]


def test_html(spark):
    page = "<title>no</title><h1>A</h1>loose<p>x <b>y</b><script>'</p>'</script> z</p><nav><p>skip</p></nav><ul><li>one<li>two</li></ul><div>bare</div><h2>B</h2><p>section 3 applies</p>"
    got = [(r.kind, r.text, r.heading_path) for r in ingestion.html_blocks(spark.createDataFrame([(1, page)], "doc_id long, html string")).orderBy("block_no").collect()]
    assert got == [("heading", "A", []), ("paragraph", "x y z", ["A"]), ("list_item", "one", ["A"]), ("list_item", "two", ["A"]), ("heading", "B", ["A"]), ("clause", "section 3 applies", ["A", "B"])]


def test_recursive_chunks(spark):
    said = "\n\n".join(" ".join(f"Word{k} goes here." for k in range(j, j + 60)) for j in range(0, 300, 60)) + "x" * 5000
    rows = ingestion.recursive_chunks(spark.createDataFrame([(1, said), (2, "short"), (3, ""), (4, None)], "doc_id long, text string"), 100).orderBy("doc_id", "chunk_no").collect()
    assert [r.text for r in rows if r.doc_id == 2] == ["short"] and not [r for r in rows if r.doc_id in (3, 4)]
    pieces = ingestion.cut_text(said, 100)
    assert all(ingestion.tokens_in(p) <= 100 for p in pieces) and re.sub(r"\s", "", "".join(pieces)).count("Word") == 300
    assert [r.text for r in rows if r.doc_id == 1][1].endswith(pieces[1])
    with pytest.raises(ValueError):
        ingestion.recursive_chunks(spark.createDataFrame([(1, said)], "doc_id long, text string"), 100, 0.5)


def test_structure_chunks(spark):
    raw = "# A\n" + "Sentence one is here. " * 30 + "\n\n# B\ntiny\n\n# C\n" + "Another sentence follows. " * 300
    blocks = ingestion.markdown_blocks(spark.createDataFrame([(1, raw)], "doc_id long, text string"))
    rows = ingestion.structure_chunks(blocks, 60, 120, 40, 300).orderBy("chunk_no").collect()
    assert rows[0].heading_path == ["A"] and all(r.text.strip() not in ("A", "B", "C") for r in rows)
    assert any(r.text.startswith("B\n\ntiny\n\nC") for r in rows) and all(r.tokens <= 140 for r in rows)
    assert any(r.parent_text and r.parent_text.endswith("[…]") for r in rows)


def test_hashed_vectors(spark):
    rows = {r.doc_id: np.array(r.vector) for r in ingestion.hashed_vectors(spark.createDataFrame([(1, "Escalate now"), (2, "escalation"), (3, "")], "doc_id long, text string"), 64).collect()}
    v = np.zeros(64)

    def put(token, w):
        n = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        v[n % 64] += w if n >> 63 else -w

    for t in ("escalate", "now"):
        put(t, 1.0)
    for k in range(5):
        put("escalate"[k : k + 4], 0.35)
    put("__document__", 0.1)
    assert np.allclose(rows[1], v / np.linalg.norm(v)) and abs(np.linalg.norm(rows[3]) - 1) < 1e-9 and rows[1] @ rows[2] > 0.2


def test_rejections(spark):
    rows = spark.createDataFrame([("  ",), ("Page 3 of 9",), ("few words",), ("enough words to be kept " * 3,)], "t string")
    assert [r[0] for r in rows.select(ingestion.rejection(F.col("t"))).collect()] == ["empty", "too_short", "too_short", None]


def test_greeting_and_routing(spark):
    rows = spark.createDataFrame([(1, "Hello!"), (2, "what is our current status right now")], "query_id long, query_text string")
    got = {r.query_id: r for r in intelligence.analysed(rows).collect()}
    assert got[1].intent == "conversational" and got[1].coverage == 1.0 and got[2].requires_live_data and got[2].volatility == "realtime"


def test_memory_empty_selector_forgets_nothing(spark):
    items = spark.createDataFrame([(1, 5)], "item_id long, created_at_ms long")
    assert memory.forgotten(items, {}).count() == 1 and memory.forgotten(items, {"item_id": 1}).count() == 0


def test_leader_clusters_depend_on_order_of_ids(spark):
    rows = [("d", 1, [1.0, 0.0]), ("d", 2, [0.9, 0.1]), ("d", 3, [0.0, 1.0]), ("d", 4, [0.7, 0.7]), ("e", 5, [0.0, 0.0])]
    got = {r.passage_id: r.cluster for r in parametric.leader_clusters(spark.createDataFrame(rows, "domain string, passage_id long, vector array<double>"), 0.9).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}


def mean_clusters_by_force(rows, bucket, centres, rounds, threshold):
    """(domain, id, vector) rows; one by one, without Spark."""
    out = {}
    for domain in {d for d, _, _ in rows}:
        mine = [(i, np.array(v) / np.linalg.norm(v)) for d, i, v in rows if d == domain and v is not None and np.linalg.norm(v) > 0]
        firsts = {}
        for i, v in sorted(mine, key=lambda x: x[0]):
            firsts.setdefault(bucket[i], v)
        means = [firsts[b] for b in sorted(firsts)]

        def closest(v, means):
            cos = [round(float(m @ v / np.linalg.norm(m)), 9) for m in means]
            return cos.index(max(cos)), max(cos)

        for _ in range(rounds):
            places = [closest(v, means)[0] for _, v in mine]
            means = [np.mean([v for (_, v), p in zip(mine, places, strict=True) if p == k], axis=0) for k in sorted(set(places))]
        last = {i: closest(v, means) for i, v in mine}
        for d, i, _ in rows:
            if d == domain:
                at, sim = last.get(i, (None, -2.0))
                fits = at is not None and sim >= threshold
                alike = [s for p, s in last.values() if p == at and s >= threshold]
                out[i] = (at, float(np.mean(alike))) if fits else (None, None)
    return out


def test_mean_clusters_by_brute_force(spark):
    rng = np.random.default_rng(4)
    ways = np.eye(6)
    rows = [("hot" if i % 3 else None, i, [float(x) for x in ways[i % 5] + rng.normal(0, 0.15, 6)]) for i in range(90)]
    rows += [("hot", 500, [0.0] * 6), ("hot", 501, None), ("one", 502, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "domain string, passage_id long, vector array<double>")
    bucket = {r[0]: r[1] for r in docs.select("passage_id", F.expr("cast(pmod(xxhash64(passage_id), 4) as int)")).collect()}
    got = {r.passage_id: (r.cluster, r.coherence) for r in parametric.mean_clusters(docs.repartition(5), 4, 2, 0.8).collect()}
    want = mean_clusters_by_force(rows, bucket, 4, 2, 0.8)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(s is None if want[i][1] is None else abs(s - want[i][1]) < 1e-5 for i, (_, s) in got.items())
    assert {c for c, _ in got.values()} > {None, 0, 1} and parametric.mean_clusters(docs.limit(0), 4, 1).count() == 0


def test_transforms_apply_where_the_analysis_calls_for_them(spark):
    asked = [
        (1, "compare sev-1 with the on-call rota?"),
        (2, "tell me what changed and then who approved it and why it broke"),
        (3, "what changed in the retention policy of last year"),
        (4, "hello"),
        (5, "; ".join(f"a{k} and then b{k}" for k in range(9)).replace(";", " ;")),
        (6, None),
    ]
    rows = intelligence.transformed(intelligence.analysed(spark.createDataFrame(asked, "query_id long, query_text string")))
    got = {r.query_id: r for r in rows.collect()}
    assert got[1].sub_queries == ["sev-1", "the on-call rota"] and "severity 1" in got[1].expanded and got[1].entities_only == "sev-1"
    assert got[2].sub_queries == ["tell me what changed", "who approved it", "why it broke"] and got[2].rewritten.startswith("what changed")
    assert got[3].sub_queries is None and got[3].rewritten is None and got[3].expanded and got[4].sub_queries is None
    assert len(got[5].sub_queries) == 6 and got[6].sub_queries is None and got[6].expanded is None


def test_running_spend_is_clamped_and_refuses_negative_amounts(spark):
    steps = spark.createDataFrame([(1, 1, 40, 0.1), (1, 2, 80, None), (1, 3, 5, 0.5), (2, 1, None, 0.0)], "request long, step long, wall_ms long, usd double")
    run = lambda s: {(r.request, r.step): (r.wall_left, round(r.usd_spent, 6), r.exhausted) for r in intelligence.spent(s, ["request"], ["step"], F.lit(100), F.lit(1.0)).collect()}
    assert run(steps) == {(1, 1): (60, 0.1, False), (1, 2): (0, 0.1, True), (1, 3): (0, 0.6, True), (2, 1): (100, 0.0, False)}
    with pytest.raises(Exception, match="negative"):
        run(steps.withColumn("wall_ms", F.lit(-1)))


def test_fusion_of_ranks_rewards_agreement(spark):
    legs = spark.createDataFrame([("q", 1, "a", 0, 1.0, 0.5), ("q", 1, "b", 1, 1.0, 0.4), ("q", 2, "a", 1, 1.0, 0.9)], "query_id string, chunk_id long, source string, rank int, weight double, effective_score double")
    got = {r.chunk_id: r for r in retrieval.reciprocal_rank_fusion(legs).collect()}
    assert got[1].fused_score == round(1 / 61 + 1 / 62, 8) > got[2].fused_score and got[1].rank_by_leg == {"a": 0, "b": 1}


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    from querent.plans import registry

    sf, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("rerank_overlap", "near_dup_pairs", "drift_monitor"):
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(repr, registry.QUERIES[name](spark, sf).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert seen[0] == seen[1]


def test_memory_trim_skips_and_goes_on(spark):
    from querent.operators import serving

    rows = [("s", 1, 0.9, 1, "x" * 40), ("s", 2, 0.8, 2, "y" * 400), ("s", 3, 0.7, 3, "z" * 20)]
    (r,) = serving.trimmed_memory(spark.createDataFrame(rows, "session_id string, item_id long, salience double, created_at_ms long, text string"), "session_id", 20).collect()
    assert r.kept == [1, 3] and r.used == 15


def test_corpus_and_cases_from_files(spark, tmp_path):
    from querent.sources import files

    (tmp_path / "t1" / "public").mkdir(parents=True)
    (tmp_path / "t1" / "public" / "doc-1.md").write_text("# Title\n\ntenant: t9\n")
    (r,) = files.markdown_corpus(spark, str(tmp_path)).collect()
    assert (r.tenant_id, r.acl_hash, r.document_id, r.source_id, r.text) == ("t1", "public", "doc-1", "kb.t1", "# Title\n\ntenant: t9\n")
    (tmp_path / "cases.jsonl").write_text('# comment\n\n{"case_id": "a", "query": "q", "expect_abstain": true}\n{"case_id": "b", "query": "r", "tenant_id": "t2"}\n')
    got = {r.case_id: r.tenant_id for r in files.cases(spark, str(tmp_path / "cases.jsonl")).collect()}
    assert got == {"a": "tenant-local", "b": "t2"}
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_near_duplicates_with_members_give_every_link(spark):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    texts = {1: words, 2: words[::-1], 3: [*words[:19], "other"], 4: [*words[:19], "other"], 5: ["own"], 6: ["own"], 7: ["alone"], 8: []}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    members = {r["id"]: r["class_id"] for r in evidence.word_set_classes(rows, "doc_id").collect()}
    assert members == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    near = {(r["left_id"], r["right_id"]) for r in evidence.near_duplicate_pairs(rows, "doc_id").collect()}
    alike = lambda a, b: len(set(texts[a]) & set(texts[b])) >= 0.85 * len(set(texts[a]) | set(texts[b]))
    got = {(a, b) for a in members for b in members if a < b and (members[a] == members[b] or tuple(sorted((members[a], members[b]))) in near)}
    assert got == {(a, b) for a in members for b in members if a < b and alike(a, b)} and (2, 4) in got and (5, 6) in got


def test_sentence_buffer_is_the_fold(spark):
    def released(pieces, most):
        held, out = "", []
        for piece in pieces:
            held += piece or ""
            while m := re.search(r"(?<=[.!?])\s+", held):
                out.append(held[: m.end()])
                held = held[m.end() :]
            at = held.rfind(" ")
            if len(held) >= most and at > 0:
                out.append(held[: at + 1])
                held = held[at + 1 :]
        return out + ([held] if held else [])

    streams = {
        1: ["One. Two", "! Three  ", "four", None, " five. "],
        2: ["words without an end " * 5, "and more", "x" * 50, " y"],
        3: ["", None],
        4: ["." * 30, " ", " a?", "\n\nb"],
        5: [" " + "z" * 60, "é. " * 9],
    }
    rows = [(k, n, p) for k, pieces in streams.items() for n, p in enumerate(pieces)]
    got = {k: [] for k in streams}
    for r in grounding.buffered_sentences(spark.createDataFrame(rows, "k long, n long, piece string"), "k", "n", 40).orderBy("k", "place").collect():
        got[r.k].append(r.released)
    assert got == {k: released(pieces, 40) for k, pieces in streams.items()}


def test_rerank_outcomes_name_the_first_reason(spark):
    asked = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, True), (4, True, True)], "query_id long, allowed boolean, expired boolean")
    pool = spark.createDataFrame([(1,), (2,), (4,), (4,)], "query_id long")
    got = {r.query_id: (r.ran, r.skipped_reason) for r in retrieval.rerank_outcomes(asked, pool).collect()}
    assert got == {1: (True, None), 2: (False, "degraded_budget"), 3: (False, "no_candidates"), 4: (False, "deadline_exceeded")}


def test_answer_scores_leave_out_what_they_cannot_judge(spark):
    from querent.operators import evaluation

    schema = "query_id long, answer string, abstained boolean, claims_total long, claims_cited long, citations array<string>, relevant array<string>, expected_facts array<string>, expect_abstain boolean, expected_outcome string, outcome string, forbidden array<string>"
    rows = [
        (1, "Alpha and beta", False, 4, 3, ["a", "b"], ["a"], ["ALPHA", "gamma"], False, None, "answered", ["delta"]),
        (2, None, None, None, None, None, None, None, None, None, None, None),
        (3, "I do not", True, 0, 0, [], ["a"], [], True, "abstained", "answered", None),
        (4, "has delta", False, 1, 1, [], ["a"], ["delta"], True, None, None, ["delta"]),
    ]
    got = {(r.query_id, r.metric_id): (r.score, r.passed) for r in evaluation.answer_scores(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[2, m] == (None, None) for m in evaluation.ANSWER_THRESHOLDS)
    want = {"groundedness": 0.75, "citation_precision": 0.5, "completeness": 0.5, "abstention_correct": 1.0, "adversarial": 1.0}
    assert {m: got[1, m][0] for m in want} == want and not got[1, "groundedness"][1] and got[1, "adversarial"][1]
    assert {m: got[3, m][0] for m in want} == {"groundedness": None, "citation_precision": None, "completeness": None, "abstention_correct": 1.0, "adversarial": 0.0}
    assert {m: got[4, m][0] for m in want} == {"groundedness": 1.0, "citation_precision": 0.0, "completeness": 1.0, "abstention_correct": 0.0, "adversarial": 0.0}


def test_contexts_are_packed_trimmed_and_rendered(spark):
    queries = spark.createDataFrame([(1, "alpha beta", 4000, 1.0), (2, "alpha", 100, 1.0), (3, None, 4000, 1.0), (4, "alpha", 4000, 0.001)], "query_id long, query_text string, context_window int, multiplier double")
    group = lambda q, n, words, score: (q, n, 20, score, 0.5, 1.0, words, [w for w in words if w in ("alpha", "beta")], 2 if q == 1 else 1, "s", n * 10, "v1", f"E{n}", " ".join(words))
    rows = [group(1, 1, ["alpha"], 0.9), group(1, 2, ["beta"], 0.8), group(1, 3, ["gamma"], 0.7), group(2, 1, ["alpha"], 0.9), group(4, 1, ["alpha"], 0.9)]
    schema = "query_id long, group_no int, tokens long, score double, authority double, freshness double, words array<string>, found array<string>, n_aspects int, source_id string, document_id long, version string, marker string, text string"
    said = [(1, 7, "likes tea", 0.5, 1), (1, 8, "word " * 3000, 0.9, 1), (1, 9, "is new", 0.7, 2), (2, 7, "x", 0.5, 1)]
    memory = spark.createDataFrame(said, "query_id long, item_id long, text string, salience double, created_at_ms long")
    got = {r.query_id: r for r in context.built(queries, spark.createDataFrame(rows, schema), memory, "Be exact.").collect()}
    blocks = [f"[E{n}] (source=s document={n}0 version=v1 authority=0.50)\n{t}" for n, t in ((1, "alpha"), (3, "gamma"), (2, "beta"))]
    facts = f"<memory>\n{context.REMEMBERED}\n[M] is new\n[M] likes tea\n</memory>"
    want = "\n\n".join(["Be exact.", facts, "<evidence>\n" + "\n\n".join([context.PREAMBLE, "", *blocks]) + "\n</evidence>", "alpha beta"])
    assert got[1].prompt == want and got[1].prompt_hash == hashlib.sha256(want.encode()).hexdigest()[:32]
    assert got[1].memory_items == [9, 7] and got[1].dropped == [] and got[1].evidence_tokens == 60 and not got[1].coverage_warning
    assert got[2].overflow and got[2].prompt is None and got[2].coverage_warning is None
    assert got[3].prompt == "Be exact." and not got[3].coverage_warning
    assert got[4].prompt == "Be exact.\n\nalpha" and got[4].dropped == [1] and got[4].coverage_warning


def test_canaries_are_seen_alike_with_and_without_a_broadcast(spark):
    rows = [(1, "a", "holds KEY-b1 here"), (2, "b", "holds KEY-b1 here"), (3, "a", "KEY-"), (4, "a", ""), (5, "a", None), (6, "c", "xx" * 3000 + "KEY-a2"), (7, "a", "KEY-b"), (7, "a", "KEY-b1 KEY-b1")]
    seen = spark.createDataFrame(rows, "query_id long, own_tenant string, text string")
    listed = spark.createDataFrame([("b", "KEY-b1"), ("b", "KEY-b1"), ("a", "KEY-a2 or more"), ("a", "KEY-a2"), ("a", ""), ("b", None)], "tenant_id string, canary string")
    for bounds in ((100, 1000), (1, 1000), (100, 5)):
        assert {r[0] for r in guardrails.sightings(seen, listed, *bounds).collect()} == {1, 6, 7}
    assert guardrails.sightings(seen, listed.limit(0)).count() == 0 and guardrails.sightings(seen, listed.limit(0), -1).count() == 0


def test_a_common_passage_makes_no_pairs_of_near_duplicates(spark):
    passage = " ".join(f"rare{k}" for k in range(40))
    texts = {d: f"{passage} " + " ".join(f"w{(d * 7919 + k * 104729) % 5003}" for k in range(120)) for d in range(60)}
    texts |= {100: texts[0] + " more", 101: texts[1].replace("rare3 ", ""), 102: texts[2], 103: "one two", 104: "two one three"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    classes, near = evidence.near_candidates(rows, [])
    sets = {d: set(t.split()) for d, t in texts.items() if d != 102}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert want and near.count() <= 2 * len(want) and classes.count() == len(sets)
    assert {(r.left_id, r.right_id): r.overlap for r in evidence.near_duplicate_pairs(rows, "id").collect()} == want
    before, evidence.BLOCK = evidence.BLOCK, 1
    try:  # in many blocks, and within a column
        found = evidence.near_duplicate_pairs(rows.withColumn("q", F.lit("a")).union(rows.withColumn("q", F.lit("b"))), "id", by="q").collect()
    finally:
        evidence.BLOCK = before
    assert {(r.q, r.left_id, r.right_id): r.overlap for r in found} == {(q, *k): v for k, v in want.items() for q in "ab"} and len(found) == 2 * len(want)


def test_candidates_are_made_once_and_few_documents_are_grouped_by_root(spark, monkeypatch):
    from querent.plans import evidence as evidence_plans
    from querent.plans import grounding as plans
    from querent.plans import retrieval as made

    sf, seen = "/root/testdata/sf0.001", []
    counted = lambda spark, sf_dir, f=made.reranked: seen.append(1) or f(spark, sf_dir)
    monkeypatch.setattr(plans, "reranked", counted)
    plans.entailment_best(spark, sf)
    assert len(seen) == 1
    rows = evidence_plans.lineage_independence(spark, sf)
    assert not [f for f in rows.inputFiles() if "documents.parquet" in f] and rows.where("lineage_root is null").isEmpty()


@pytest.mark.parametrize("changed", [{}, {"TILE": 16, "BLOCK": 50, "LONG": 100}, {"SENT": 10, "LONG": 100}])
def test_a_crowd_of_near_copies_is_not_listed_pair_by_pair(spark, monkeypatch, changed):
    rng = random.Random(7)
    bases = [[f"b{b}w{k}" for k in range(n)] for b, n in enumerate((120, 120, 60, 900))]

    def edited(base, most):
        words = list(base)
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        return " ".join(words)

    texts = {d: edited(bases[0], 9) for d in range(150)} | {d: edited(bases[1], 9) for d in range(200, 240)} | {d: edited(bases[2], 6) for d in range(300, 306)} | {d: edited(bases[3], 99) for d in range(400, 406)}
    texts |= {500 + k: f"{' '.join(bases[0][:20])} " + " ".join(f"own{k * 1000 + i}" for i in range(200)) for k in range(20)} | {600: texts[3], 601: texts[3], 602: texts[302], 603: "", 604: None, 605: "one"}
    for name, value in changed.items():
        monkeypatch.setattr(evidence, name, value)
    sets, seen = {}, set()
    for d, t in texts.items():
        words = frozenset((t or "").split())
        if words and words not in seen:
            sets[d] = words
            seen.add(words)
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(d, t, q) for d, t in texts.items() for q in ("a", "b")] + [(d, t, None) for d, t in texts.items()], "id long, text string, q string")
    classes, near = evidence.near_candidates(rows.select("id", "q", "text"), ["q"])
    assert len(want) > 5000 and near.count() * 10 < 2 * len(want) and classes.where("q = 'a'").count() == len(sets)
    found = evidence.near_duplicate_pairs(rows, "id", by="q").collect()
    assert {(r.q, r.left_id, r.right_id): r.overlap for r in found} == {(q, *k): v for k, v in want.items() for q in "ab"} and len(found) == 2 * len(want)
