"""The registry of adapters, checked weights, and the staged run that fills it."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import adapters as ad
from querent.operators import parameterization as pz
from querent.sources import versions

NEW = "adapter_id string, version int, tenant_scope string, domain string, weight double, centroid array<double>, source_document_ids array<string>, created_at_ms long, data binary"


def rows(spark, *keys, scope="t1", domain="d", docs=("1",), weight=0.5):
    return spark.createDataFrame([(a, v, scope, domain, weight, [1.0], list(docs), 5, bytearray(f"{a}{v}".encode())) for a, v in keys], NEW)


def keys(spark, *pairs):
    return spark.createDataFrame(list(pairs), "adapter_id string, version int")


def statuses(reg):
    return {(r.adapter_id, r.version): r.status for r in ad.records(reg).collect()}


def test_records_are_immutable_and_promotion_deprecates(spark, tmp_path):
    reg = ad.registered(ad.created(spark, str(tmp_path / "r")), rows(spark, ("a", 1), ("b", 1)))
    for again in (rows(spark, ("a", 1)), rows(spark, ("c", 1), ("c", 1))):
        with pytest.raises(ad.Refused, match="a version 1|c version 1"):
            ad.registered(reg, again)
    with pytest.raises(ad.Refused, match="unknown"):
        ad.with_status(reg, keys(spark, ("z", 1)), "shadow", 1)
    assert statuses(reg) == {("a", 1): "candidate", ("b", 1): "candidate"}
    reg = ad.promoted(reg, keys(spark, ("a", 1), ("b", 1)), 10)
    reg = ad.registered(reg, rows(spark, ("a", 2)))
    reg = ad.promoted(ad.with_status(reg, keys(spark, ("a", 2)), "shadow", 11), keys(spark, ("a", 2)), 12)
    assert statuses(reg) == {("a", 1): "deprecated", ("a", 2): "active", ("b", 1): "active"}
    got = {(r.adapter_id, r.version): (r.promoted_at_ms, r.deprecated_at_ms) for r in ad.records(ad.reopened(spark, reg.folder)).collect()}
    assert got == {("a", 1): (10, 12), ("a", 2): (12, None), ("b", 1): (10, None)}
    with pytest.raises(ad.Refused, match="two versions"):
        ad.promoted(reg, keys(spark, ("a", 1), ("a", 2)), 13)


def test_shadow_traffic_decides(spark, tmp_path):
    reg = ad.registered(ad.created(spark, str(tmp_path / "r")), rows(spark, ("a", 1), ("b", 1), ("c", 1)))
    measures = spark.createDataFrame([("a", 1, 0.9, 0.9), ("b", 1, 0.85, 0.9), ("c", 1, 0.89, 0.9)], "adapter_id string, version int, parametric_faithfulness double, baseline_faithfulness double")
    reg, judged = ad.promoted_from_shadow(reg, measures, 3)
    assert statuses(reg) == {("a", 1): "active", ("b", 1): "candidate", ("c", 1): "active"}
    assert [(r.adapter_id, r.reason) for r in judged.where("reason is not null").collect()] == [("b", "shadow_faithfulness_regression")]


def test_of_two_writers_one_starts_again(spark, tmp_path):
    reg = ad.registered(ad.created(spark, str(tmp_path / "r")), rows(spark, ("a", 1)))
    ad.promoted(reg, keys(spark, ("a", 1)), 1)
    with pytest.raises(versions.Conflict):
        ad.with_status(reg, keys(spark, ("a", 1)), "revoked", 2)
    assert statuses(ad.reopened(spark, reg.folder)) == {("a", 1): "active"}


def test_revocation_scope_and_coverage(spark, tmp_path):
    reg = ad.registered(ad.created(spark, str(tmp_path / "r")), rows(spark, ("a", 1), docs=("1", "2")).union(rows(spark, ("g", 1), scope="global", docs=("3",), domain="e")).union(rows(spark, ("w", 1), domain="f", weight=0.1)))
    reg = ad.promoted(reg, keys(spark, ("a", 1), ("g", 1), ("w", 1)), 1)
    tenants = spark.createDataFrame([("t1",), ("t2",), ("global",)], "tenant_id string")
    assert {(r.tenant_id, r.adapter_id) for r in ad.servable(reg, tenants).collect()} == {("t1", "a"), ("t1", "w"), ("t1", "g"), ("t2", "g"), ("global", "g")}
    asked = spark.createDataFrame([("t1", "d"), ("t1", "e"), ("t1", "f"), ("t2", "d")], "tenant_id string, domain string")
    assert {tuple(r) for r in ad.covered(reg, asked).collect()} == {("t1", "d", True, True), ("t1", "e", True, False), ("t1", "f", False, False), ("t2", "d", False, False)}
    reg, hit = ad.revoked(reg, spark.createDataFrame([("2",), ("9",)], "document_id string"), 7)
    assert [tuple(r) for r in hit.collect()] == [("a", 1)] and statuses(reg)["a", 1] == "revoked"
    assert not ad.servable(reg, tenants).where("adapter_id = 'a'").count()


def test_weights_are_read_with_their_digest(spark, tmp_path):
    reg = ad.registered(ad.created(spark, str(tmp_path / "r")), rows(spark, ("a", 1), ("b", 1)))
    got = {r.adapter_id: (r.data and bytes(r.data), r.error) for r in ad.loaded(reg, keys(spark, ("a", 1), ("z", 1))).collect()}
    assert got == {"a": (b"a1", None), "z": (None, ad.NOT_FOUND)}
    (tmp_path / "f" / "x").mkdir(parents=True)
    (tmp_path / "f" / "x" / "one").write_bytes(b"weights")
    (tmp_path / "f" / "two").write_bytes(b"changed")
    held = ad.files(spark, str(tmp_path / "f"))
    digest = lambda b: __import__("hashlib").sha256(b).hexdigest()
    wanted = spark.createDataFrame([("x/one", digest(b"weights")), ("two", digest(b"original")), ("two", None), ("three", digest(b""))], "key string, blob_sha256 string")
    got = sorted((r.key, r.data and bytes(r.data), r.error) for r in ad.verified(wanted, held).collect())
    assert got == [("three", None, ad.NOT_FOUND), ("two", None, ad.MISMATCH), ("two", None, ad.MISMATCH), ("x/one", b"weights", None)]


FLAGS = "knowledge_class string, acl_narrower_than_tenant boolean, revocation_sla_hours double, requires_exact_quotation boolean, half_life_days double, requires_per_claim_provenance boolean, contested boolean, contains_pii boolean, training_usd double, queries_per_period double, usd_per_query double"
CLUSTER = f"cluster_id string, domain string, tenant_scope string, tenant_id string, coherence double, centroid array<double>, {FLAGS}"
GOOD = ("reference", False, None, False, 365.0, False, False, False, 1.0, 1000.0, 0.01)


def cluster(name, scope="t1", tenant="t1", **more):
    flags = dict(zip([f.split()[0] for f in FLAGS.split(", ")], GOOD)) | more
    return (name, "billing", scope, tenant, 0.9, [1.0, 0.0], *flags.values())


SENTENCES = [
    "Invoices are archived seven years inside regional storage vaults under encryption.",
    "Refund requests beyond thirty calendar days need written approval from finance managers.",
    "Payment terminals restart automatically after firmware updates every second Tuesday morning.",
]


def words(body):
    found = [w for w in dict.fromkeys(re.findall(text.PLAIN, body.lower())) if len(w) >= 3 and w not in text.PARAMETRIC_STOP]
    return set(found) | {w[:5] for w in found if len(w) > 5}


def brute_recall(train, held_out):
    hits = 0
    for q, a in held_out:
        asked = words(q)
        best = max(((round(len(asked & (words(x) | words(y))) / len(asked), 6), y) for x, y in train), default=(0, ""))
        hits += best[0] > 0 and best[1] == a
    return hits / len(held_out)


def run(spark, tmp_path, clusters, passages, **more):
    reg = ad.created(spark, str(tmp_path / "r"))
    return pz.parameterized(reg, spark.createDataFrame(clusters, CLUSTER), spark.createDataFrame(passages, "cluster_id string, document_id string, text string"), 77, **more)


def test_each_cluster_stops_at_its_first_refusal(spark, tmp_path):
    whole = " ".join(SENTENCES)
    clusters = [cluster("good"), cluster("leak", scope="global"), cluster("other", scope="t2"), cluster("pii", contains_pii=True, contested=True), cluster("rare", queries_per_period=10.0), cluster("empty"), cluster("short"), cluster("clash")]
    passages = [("good", "1", whole), ("good", "2", whole), ("leak", "3", whole), ("other", "4", whole), ("pii", "5", whole), ("rare", "6", whole), ("short", "7", "Too short."), ("empty", "8", None)]
    # two answers to the same words: the greater one is given to both, so that half of the held-out questions fail
    passages += [("clash", "9", SENTENCES[0]), ("clash", "10", "Under encryption vaults storage regional inside years seven archived are Invoices.")]
    reg, report = run(spark, tmp_path, clusters, passages)
    got = {r.cluster_id: r for r in report.collect()}
    assert len(got) == len(clusters)
    assert got["leak"].refused == ["tenant_knowledge_in_global_adapter"] and got["leak"].steps == ["scope:refused"]
    assert got["other"].refused == ["adapter_scope_differs_from_knowledge_tenant"]
    assert got["pii"].refused == ["contested", "contains_pii"] and got["pii"].steps == ["scope", "eligibility:refused"]
    assert "volume_below_floor" in got["rare"].refused
    for name in ("empty", "short"):
        assert got[name].refused == ["nothing_to_train_on"] and got[name].steps == ["scope", "eligibility", "augmentation", "augmentation:refused"]
    good = got["good"]
    assert good.steps == ["scope", "eligibility", "augmentation", "training", "promotion_gate", "registered", "shadow"] and good.refused == []
    assert (good.adapter_id, good.version, good.duplicate) == ("t1.billing.good", 1, 9)
    record = ad.records(reg).collect()
    assert [(r.adapter_id, r.status, r.source_document_ids, r.created_at_ms, r.weight) for r in record if r.adapter_id.endswith("good")] == [("t1.billing.good", "shadow", ["1", "2"], 77, 0.9)]
    (blob,) = ad.loaded(reg, keys(spark, ("t1.billing.good", 1))).collect()
    pairs = json.loads(bytes(blob.data))
    assert len(pairs) == 6 and {p["answer"] for p in pairs} == set(SENTENCES)
    made = pz.parametric.augmented(spark.createDataFrame([("1", t) for t in SENTENCES], "document_id string, text string")).collect()
    want = brute_recall([(r.question, r.answer) for r in made if r.surface < 2], [(r.question, r.answer) for r in made if r.surface == 2])
    assert good.recall == want == 1.0
    if got["clash"].recall < 0.8:
        assert got["clash"].steps[-1] == "promotion_gate:refused" and got["clash"].refused == ["knowledge_recall_below_floor"]
    # run again: the next version
    reg, report = pz.parameterized(reg, spark.createDataFrame(clusters[:1], CLUSTER), spark.createDataFrame(passages[:2], "cluster_id string, document_id string, text string"), 78)
    assert [(r.adapter_id, r.version) for r in report.collect()] == [("t1.billing.good", 2)] and Counter(statuses(reg).values())["shadow"] >= 2


def test_probes_and_siblings_refuse(spark, tmp_path):
    passages = [("a", "1", " ".join(SENTENCES))]
    probes = spark.createDataFrame([("how are invoices archived inside vaults",), ("weather forecast tomorrow",)], "question string")
    _, report = run(spark, tmp_path, [cluster("a")], passages, probes=probes)
    (r,) = report.collect()
    assert r.regression == 0.5 and r.refused == ["general_regression_above_tolerance"]
    # a sibling that answers the same words with a greater string takes the questions over
    sibling = spark.createDataFrame([("a", s.lower(), "zzz " + s) for s in SENTENCES], "cluster_id string, question string, answer string")
    _, report = run(spark, tmp_path / "two", [cluster("a")], passages, siblings=sibling)
    (r,) = report.collect()
    assert r.interference == 1.0 and r.refused == ["interference_above_tolerance"] and r.recall == 1.0


def test_what_the_sources_do_not_entail_stops_the_run(spark, tmp_path, monkeypatch):
    made = pz.parametric.augmented
    monkeypatch.setattr(pz.parametric, "augmented", lambda p, by=None: made(p, by).withColumn("answer", F.when(F.col("n") == 0, "Invented facts nobody ever wrote anywhere before").otherwise(F.col("answer"))))
    _, report = run(spark, tmp_path, [cluster("a")], [("a", "1", " ".join(SENTENCES))])
    (r,) = report.collect()
    assert r.refused == ["augmenter_not_entailed_rate_too_high"] and r.not_entailed == 3 and r.steps[-1] == "augmentation:refused"


def test_no_clusters(spark, tmp_path):
    _, report = run(spark, tmp_path, [], [("a", "1", "x")])
    assert report.count() == 0
