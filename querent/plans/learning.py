"""Queries over the parametric tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import adapters, parameterization, parametric
from querent.sources import catalog
from querent.sources.shared import folder

from . import base
from .base import query

_PW = lambda c: base.with_stems(base.content(c, text.PLAIN, text.PARAMETRIC_STOP, 3))
_PAIRS = f"""src AS (SELECT item_id AS document_id, text FROM benchmark), se AS (SELECT document_id, unnest({base.sentences("trim(regexp_replace(text, '\\s+', ' ', 'g'))")}) AS answer, generate_subscripts({base.sentences("trim(regexp_replace(text, '\\s+', ' ', 'g'))")}, 1) - 1 AS n FROM src),
wd AS (SELECT *, list_filter(regexp_extract_all(answer, '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda w: length(w) > 2 AND NOT list_contains({base.listed(text.PARAMETRIC_STOP)}, lower(w))) AS w FROM se),
sf AS (SELECT document_id, n, answer, unnest([w[1:greatest(3, floor(len(w) * 2 / 3)::int)], w[floor(len(w) / 3)::int + 1:], list_filter(w, lambda x, i: i % 2 = 1)]) AS q, unnest([0, 1, 2]) AS surface FROM wd WHERE len(w) >= 6),
pairs AS (SELECT document_id, n, surface, lower(array_to_string(q, ' ')) AS question, answer FROM sf)"""


def sources(spark, sf_dir):
    return catalog.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"), "text")


def pairs(spark, sf_dir):
    return parametric.augmented(sources(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT document_id, n, surface, question, answer FROM pairs")
def qa_augment(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {_PAIRS}, hd AS (SELECT document_id, {_PW("text")} AS held FROM src), pw AS (SELECT p.*, held, {_PW("question")} AS asked, {_PW("answer")} AS said FROM pairs p LEFT JOIN hd USING (document_id)),
wy AS (SELECT *, CASE WHEN len(said) = 0 OR {base.covered("said", "held")} < 0.85::double THEN 'not_entailed' WHEN len(asked) < 2 THEN 'low_diversity' END AS why FROM pw)
SELECT document_id, n, surface, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL, array_to_string(list_sort(asked), ' '), answer ORDER BY document_id, n, surface) > 1 THEN 'duplicate' END) AS reason FROM wy"""
)
def qa_filter(spark, sf_dir):
    rows = parametric.filtered_pairs(pairs(spark, sf_dir), sources(spark, sf_dir))
    return rows.select("document_id", F.col("n").cast("long").alias("n"), "surface", "reason")


_RECALL = f"""{_PAIRS}, st AS (SELECT document_id % 4 AS adapter_id, answer, list_distinct(list_concat({_PW("question")}, {_PW("answer")})) AS held FROM pairs WHERE surface < 2),
qs AS (SELECT document_id % 4 AS adapter_id, document_id * 1000 + n AS question_id, answer AS want, {_PW("question")} AS asked FROM pairs WHERE surface = 2),
sc AS (SELECT q.adapter_id, question_id, want, answer, round(len(list_intersect(asked, held))::double / len(asked), 6) AS score FROM qs q JOIN st s ON q.adapter_id = s.adapter_id AND len(list_intersect(asked, held)) > 0),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY adapter_id, question_id ORDER BY score DESC, answer DESC) = 1),
rc AS (SELECT q.adapter_id, count(*) AS probes, round(avg((coalesce(b.answer, '') = q.want)::int), 6) AS recall FROM qs q LEFT JOIN bs b USING (adapter_id, question_id) GROUP BY 1)"""


def recalls(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("adapter_id", F.col("document_id") % 4)
    asked = rows.where("surface = 2").select("adapter_id", (F.col("document_id") * 1000 + F.col("n")).alias("question_id"), "question", F.col("answer").alias("want"))
    got = parametric.answered(asked, rows.where("surface < 2"))
    joined = asked.join(got, ["adapter_id", "question_id"])
    return joined.groupBy("adapter_id").agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg((F.coalesce("answer", F.lit("")) == F.col("want")).cast("double")), 6).alias("recall"))


@query(f"WITH {_RECALL} SELECT * FROM rc")
def adapter_recall(spark, sf_dir):
    return recalls(spark, sf_dir)


@query(
    f"""WITH {_RECALL} SELECT adapter_id, array_to_string(list_filter([CASE WHEN recall < 0.8 THEN 'knowledge_recall_below_floor' END, CASE WHEN adapter_id % 2 = 0 THEN 'general_regression_above_tolerance' END,
  CASE WHEN adapter_id = 3 THEN 'interference_above_tolerance' END], lambda x: x IS NOT NULL), ',') AS reasons FROM rc"""
)
def promotion_gate(spark, sf_dir):
    n = F.col("adapter_id")
    why = parametric.promotion_reasons(F.col("recall"), F.when(n % 2 == 0, 0.1).otherwise(0.0), F.when(n == 3, 0.2).otherwise(0.0))
    return recalls(spark, sf_dir).select("adapter_id", F.array_join(why, ",").alias("reasons"))


@query(
    """WITH r AS (SELECT vec_id AS record_id, CASE vec_id % 7 WHEN 0 THEN 'live' ELSE 'reference' END AS kc, vec_id % 11 = 0 AS acl, CASE WHEN vec_id % 3 = 0 THEN (vec_id % 400)::double END AS sla, vec_id % 13 = 0 AS quo, (vec_id % 200)::double AS hl, vec_id % 2 = 0 AS prov, vec_id % 17 = 0 AS con, vec_id % 19 = 0 AS pii,
  (vec_id % 50) / 10.0::double AS tr, (vec_id % 9) * 200.0::double AS vol, 0.0043::double AS ng, (vec_id % 10) / 10.0::double AS coh FROM embeddings),
b AS (SELECT *, list_filter([CASE WHEN kc = 'live' THEN 'knowledge_class_not_parameterizable' END, CASE WHEN acl THEN 'acl_narrower_than_tenant' END, CASE WHEN sla < 168 THEN 'revocation_sla_shorter_than_retrain_cadence' END, CASE WHEN quo THEN 'requires_exact_quotation' END,
  CASE WHEN hl < 90 THEN 'half_life_below_floor' END, CASE WHEN con THEN 'contested' END, CASE WHEN pii THEN 'contains_pii' END], lambda x: x IS NOT NULL) AS bl, CASE WHEN vol > 0 THEN tr / vol END AS am FROM r),
e AS (SELECT *, CASE WHEN len(bl) > 0 THEN [] ELSE list_filter([CASE WHEN vol < 500 THEN 'volume_below_floor' END, CASE WHEN NOT coalesce(am < ng * 0.6::double, false) THEN 'savings_below_threshold' END, CASE WHEN coh < 0.55 THEN 'cluster_incoherent' END], lambda x: x IS NOT NULL) END AS ec FROM b)
SELECT record_id, array_to_string(bl, ',') AS blocking, array_to_string(ec, ',') AS economic, len(bl) = 0 AND len(ec) = 0 AS eligible, CASE WHEN len(bl) = 0 THEN round(am, 9) END AS amortised_usd FROM e"""
)
def eligibility_gate(spark, sf_dir):
    n = F.col("vec_id")
    rows = catalog.table(spark, sf_dir, "embeddings").select(
        n.alias("record_id"), F.when(n % 7 == 0, "live").otherwise("reference").alias("knowledge_class"), (n % 11 == 0).alias("acl_narrower_than_tenant"), F.when(n % 3 == 0, (n % 400).cast("double")).alias("revocation_sla_hours"),
        (n % 13 == 0).alias("requires_exact_quotation"), (n % 200).cast("double").alias("half_life_days"), (n % 2 == 0).alias("requires_per_claim_provenance"), (n % 17 == 0).alias("contested"), (n % 19 == 0).alias("contains_pii"),
        ((n % 50) / F.lit(10.0)).alias("training_usd"), ((n % 9) * F.lit(200.0)).alias("queries_per_period"), F.lit(0.0043).alias("usd_per_query"), ((n % 10) / F.lit(10.0)).alias("coherence"),
    )
    return parametric.eligibility(rows).select("record_id", F.array_join("blocking", ",").alias("blocking"), F.array_join("economic", ",").alias("economic"), "eligible", "amortised_usd")


_CENTROIDS = """v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), el AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
mn AS (SELECT label, i, round(avg(x), 9) AS x FROM el GROUP BY ALL), ce AS (SELECT label AS adapter_id, list(x ORDER BY i) AS c FROM mn GROUP BY 1)"""


def centroids(spark, sf_dir):
    """Element-wise means of each label's vectors: exploded by place, so that no label is gathered."""
    rows = catalog.table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("centroid"))


@query(
    f"""WITH {_CENTROIDS}, s AS (SELECT vec_id AS query_id, adapter_id, round(least(1.0, greatest(0.0, list_cosine_similarity(e, c))), 6) AS coverage FROM v JOIN ce ON vec_id % 3 = adapter_id % 3 WHERE vec_id % 50 = 0 AND adapter_id % 4 <> 3)
SELECT query_id, adapter_id, coverage, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, adapter_id) - 1 AS place FROM s WHERE coverage >= 0.1 QUALIFY place < 3"""
)
def adapter_select(spark, sf_dir):
    known = centroids(spark, sf_dir)
    adapters = known.select(F.col("label").cast("long").alias("adapter_id"), (F.col("label") % 3).cast("long").alias("tenant_id"), F.lit("b1").alias("base"), F.lit("e1").alias("embedding"), F.when(F.col("label") % 4 == 3, "shadow").otherwise("promoted").alias("status"), "centroid")
    asking = catalog.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 3).alias("tenant_id"), F.lit("b1").alias("base"), F.lit("e1").alias("embedding"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = parametric.selected_adapters(asking, adapters, floor=0.1)
    return rows.select("query_id", F.col("adapter_id").cast("int").alias("adapter_id"), "coverage", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT vec_id // 10 AS adapter_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def revoke_documents(spark, sf_dir):
    adapters = catalog.table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("adapter_id")).agg(F.collect_set("vec_id").alias("source_document_ids"))
    return parametric.revoked(adapters, catalog.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query(
    """WITH t AS (SELECT user_id AS adapter_id, user_id % 5 AS slot, CASE event_type WHEN 'error' THEN 'shadow' ELSE 'promoted' END AS status, event_id AS at_ms FROM events),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY adapter_id ORDER BY at_ms DESC) = 1),
m AS (SELECT *, max(CASE WHEN status = 'promoted' THEN at_ms END) OVER (PARTITION BY slot) AS top FROM l)
SELECT adapter_id, slot, CASE WHEN status = 'promoted' AND at_ms <> top THEN 'deprecated' ELSE status END AS status FROM m"""
)
def adapter_status(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("adapter_id"), (F.col("user_id") % 5).alias("slot"), F.when(F.col("event_type") == "error", "shadow").otherwise("promoted").alias("status"), F.col("event_id").alias("at_ms"))
    return parametric.latest_status(rows)


@query()
def cluster_leader(spark, sf_dir):
    """Running means depend on order; tests hold the brute force."""
    rows = catalog.table(spark, sf_dir, "embeddings").select(F.col("label").alias("domain"), F.col("vec_id").alias("passage_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return parametric.leader_clusters(rows, 0.3)


@query()
def cluster_means(spark, sf_dir):
    """Means in rounds are beyond a twin in SQL; tests hold the brute force."""
    rows = catalog.table(spark, sf_dir, "embeddings").select(F.col("label").alias("domain"), F.col("vec_id").alias("passage_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return parametric.mean_clusters(rows, threshold=0.3)


#: An adapter for each source, language and thousand characters: version 1 learns from its documents of good quality, version
#: 2 from those of low quality. All first versions are promoted, then second ones that learn from more; toxic documents revoke.
_TAUGHT = """t AS (SELECT concat_ws('.', source, lang, n_chars // 1000) AS adapter_id, CASE quality WHEN 1 THEN 1 ELSE 2 END AS version, doc_id, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT adapter_id, version, count(*) AS n, bool_or(toxic = 1) AS gone, sha256(string_agg(doc_id::varchar, ',' ORDER BY doc_id)) AS blob_sha256 FROM t GROUP BY ALL),
p AS (SELECT a.*, b.n AS other FROM r a LEFT JOIN r b ON a.adapter_id = b.adapter_id AND b.version = 3 - a.version)"""


@query(
    f"""WITH {_TAUGHT} SELECT adapter_id, version, CASE WHEN gone THEN 'revoked' WHEN version = 1 THEN CASE WHEN coalesce(other > n, false) THEN 'deprecated' ELSE 'active' END
  WHEN n > coalesce(other, 0) THEN 'active' ELSE 'candidate' END AS status, blob_sha256 FROM p"""
)
def adapter_registry(spark, sf_dir):
    """The registry after registration, two promotions and a revocation, as a reader opens it; weights checked as they load."""
    labels = catalog.table(spark, sf_dir, "labels")
    docs = catalog.table(spark, sf_dir, "documents").join(labels, "doc_id")
    taught = docs.select(F.concat_ws(".", "source", "lang", F.expr("n_chars div 1000")).alias("adapter_id"), F.when(F.col("quality") == 1, 1).otherwise(2).alias("version"), "doc_id", "toxic")
    rows = taught.groupBy("adapter_id", "version").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    ids = F.col("ids").cast("array<string>")
    new = rows.select(
        "adapter_id", "version", F.lit("tenant-0").alias("tenant_scope"), F.lit("kb").alias("domain"), F.lit(1.0).alias("weight"), F.array(F.lit(1.0)).alias("centroid"),
        ids.alias("source_document_ids"), F.lit(catalog.CLOCK_MS).alias("created_at_ms"), F.array_join(ids, ",").cast("binary").alias("data"),
    )
    reg = adapters.registered(adapters.created(spark, folder(spark, "registry")), new)
    sizes = rows.groupBy("adapter_id").agg(*[F.coalesce(F.max(F.when(F.col("version") == v, F.size("ids"))), F.lit(0)).alias(f"n{v}") for v in (1, 2)])
    reg = adapters.promoted(reg, rows.where("version = 1"), catalog.CLOCK_MS + 1)
    reg = adapters.promoted(reg, sizes.where("n2 > n1").select("adapter_id", F.lit(2).alias("version")), catalog.CLOCK_MS + 2)
    adapters.revoked(reg, taught.where("toxic = 1").select(F.col("doc_id").alias("document_id")), catalog.CLOCK_MS + 3)
    reg = adapters.reopened(spark, reg.folder)
    held = adapters.records(reg).select("adapter_id", "version", "status")
    weights = adapters.loaded(reg, held).where("error is null").select("adapter_id", "version", F.sha2("data", 256).alias("blob_sha256"))
    return held.join(weights, ["adapter_id", "version"])


_CLUSTER_RECALL = f"""{_PAIRS}, hd AS (SELECT document_id, {_PW("text")} AS held FROM src),
pw AS (SELECT p.*, p.document_id % 3 AS cluster_id, {_PW("question")} AS asked, {_PW("answer")} AS said, held FROM pairs p JOIN hd USING (document_id)),
wy AS (SELECT *, CASE WHEN len(said) = 0 OR {base.covered("said", "held")} < 0.85::double THEN 'not_entailed' WHEN len(asked) < 2 THEN 'low_diversity' END AS why FROM pw),
rs AS (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY cluster_id, why IS NULL, array_to_string(list_sort(asked), ' '), answer ORDER BY document_id, n, surface) > 1 THEN 'duplicate' END) AS reason FROM wy),
ct AS (SELECT cluster_id, count(*) FILTER (reason = 'duplicate') AS duplicate FROM rs GROUP BY 1),
st AS (SELECT cluster_id, answer, list_distinct(list_concat(asked, said)) AS held FROM rs WHERE reason IS NULL AND surface < 2),
qs AS (SELECT row_number() OVER () AS q, cluster_id, answer AS want, asked FROM rs WHERE reason IS NULL AND surface = 2),
sc AS (SELECT q, answer, round(len(list_intersect(asked, held))::double / len(asked), 6) AS score FROM qs JOIN st USING (cluster_id) WHERE len(list_intersect(asked, held)) > 0),
bs AS (SELECT q, answer FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, answer DESC) = 1),
rc AS (SELECT cluster_id, round(avg((coalesce(bs.answer, '') = want)::int), 6) AS recall FROM qs LEFT JOIN bs USING (q) GROUP BY 1),
cl AS (SELECT item_id % 3 AS cluster_id, bool_or(contains(text, '"')) AS quoted, count(*) * 100 AS volume FROM benchmark GROUP BY 1)"""


@query(
    f"""WITH {_CLUSTER_RECALL} SELECT cluster_id, CASE WHEN cluster_id = 2 THEN 'scope:refused' WHEN quoted THEN 'scope,eligibility:refused'
  WHEN recall < 0.8 THEN 'scope,eligibility,augmentation,training,promotion_gate:refused' ELSE 'scope,eligibility,augmentation,training,promotion_gate,registered,shadow' END AS steps,
  CASE WHEN cluster_id = 2 THEN 'tenant_knowledge_in_global_adapter' WHEN quoted THEN 'requires_exact_quotation' WHEN recall < 0.8 THEN 'knowledge_recall_below_floor' ELSE '' END AS refused,
  CASE WHEN cluster_id < 2 AND NOT quoted THEN duplicate END AS duplicate, CASE WHEN cluster_id < 2 AND NOT quoted THEN recall END AS recall,
  CASE WHEN cluster_id < 2 AND NOT quoted AND recall >= 0.8 THEN 'tenant-' || cluster_id || '.kb.' || cluster_id END AS adapter_id FROM cl JOIN ct USING (cluster_id) JOIN rc USING (cluster_id)"""
)
def parameterize_clusters(spark, sf_dir):
    """A cluster for each tenant's benchmark items; the last one asks for an adapter that would serve every tenant."""
    cluster = (F.col("item_id") % 3).alias("cluster_id")
    items = catalog.table(spark, sf_dir, "benchmark").select(cluster, F.col("item_id").alias("document_id"), "text")
    facts = items.groupBy("cluster_id").agg(F.bool_or(F.contains("text", F.lit('"'))).alias("requires_exact_quotation"), (F.count(F.lit(1)) * 100.0).alias("queries_per_period"), (F.sum(F.length("text")) / 1e6).alias("training_usd"))
    tenant, no = F.concat(F.lit("tenant-"), "cluster_id"), F.lit(False)
    clusters = facts.select(
        "*", tenant.alias("tenant_id"), F.when(F.col("cluster_id") == 2, adapters.GLOBAL).otherwise(tenant).alias("tenant_scope"), F.lit("kb").alias("domain"), F.lit(0.9).alias("coherence"), F.array(F.lit(1.0)).alias("centroid"),
        F.lit("reference").alias("knowledge_class"), no.alias("acl_narrower_than_tenant"), F.lit(None).cast("double").alias("revocation_sla_hours"), F.lit(180.0).alias("half_life_days"),
        no.alias("requires_per_claim_provenance"), no.alias("contested"), no.alias("contains_pii"), F.lit(0.0043).alias("usd_per_query"),
    )
    _, report = parameterization.parameterized(adapters.created(spark, folder(spark, "registry")), clusters, items, catalog.CLOCK_MS)
    return report.select("cluster_id", F.array_join("steps", ",").alias("steps"), F.array_join("refused", ",").alias("refused"), "duplicate", F.round("recall", 6).alias("recall"), "adapter_id")
