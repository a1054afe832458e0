"""The registry of adapters: immutable records, their status over time, and their weights with a checksum.

A folder holds a registry: tables of records, of changes of status and of blobs, each written once, and versions (see
querent.sources.versions) that list those which count. Every change is one commit, so a promotion and the deprecation that
goes with it are seen together, and of two writers one fails with Conflict and starts again.

Records are keyed by (adapter_id, version). A key that is registered already, or twice in a batch, is refused as a whole, as
is a status for an unknown key. A status holds until the next one; a record without one is a candidate. Weights are read
with their digest checked: what is missing or differs comes as a row with an error and no data, and the others come whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources import versions

GLOBAL = "global"
NOT_FOUND, MISMATCH = "adapter blob not found", "adapter blob checksum mismatch"
KEY = ["adapter_id", "version"]
RECORD = "adapter_id string, version int, tenant_scope string, domain string, weight double, centroid array<double>, source_document_ids array<string>, blob_sha256 string, created_at_ms bigint"
CHANGE = "adapter_id string, version int, status string, at_ms bigint, seq int"
BLOB = "key string, data binary"
#: Keys named in an error at most.
_NAMED = 5


class Refused(ValueError):
    """A change that the registry does not take."""


@dataclass(frozen=True)
class Registry:
    """A registry as of one version."""

    spark: SparkSession
    folder: str
    version: int
    state: dict


def created(spark: SparkSession, folder: str) -> Registry:
    state = {"records": [], "changes": [], "blobs": []}
    return Registry(spark, folder, versions.commit(spark, folder, 0, state), state)


def reopened(spark: SparkSession, folder: str) -> Registry:
    version, state = versions.latest(spark, folder)
    if not version:
        raise ValueError(f"no registry in {folder}")
    return Registry(spark, folder, version, state)


def _table(reg: Registry, kind: str, schema: str) -> DataFrame:
    paths = [f"{reg.folder}/{p}" for p in reg.state[kind]]
    return reg.spark.read.schema(schema).parquet(*paths) if paths else reg.spark.createDataFrame([], schema)


def _written(reg: Registry, kind: str, rows: DataFrame) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{reg.folder}/{name}")
    return name


def _with(reg: Registry, **more: str) -> Registry:
    """The version with a further table of each named kind."""
    state = reg.state | {k: [*reg.state[k], v] for k, v in more.items()}
    return Registry(reg.spark, reg.folder, versions.commit(reg.spark, reg.folder, reg.version, state), state)


def blob_key() -> Column:
    return F.concat(F.lit("adapters/"), F.col("adapter_id"), F.lit("/"), F.col("version"))


def records(reg: Registry) -> DataFrame:
    """Records with their status and when it was last active or deprecated."""
    when = lambda status: F.max(F.when(F.col("status") == status, F.col("at_ms")))
    last = _table(reg, "changes", CHANGE).groupBy(*KEY).agg(F.max_by("status", "seq").alias("status"), when("active").alias("promoted_at_ms"), when("deprecated").alias("deprecated_at_ms"))
    return _table(reg, "records", RECORD).join(last, KEY, "left").withColumn("status", F.coalesce("status", F.lit("candidate")))


def _refuse(rows: DataFrame, why: str) -> None:
    if found := rows.select(*KEY).limit(_NAMED).collect():
        raise Refused(f"{why}: {', '.join(f'{r.adapter_id} version {r.version}' for r in found)}")


def registered(reg: Registry, rows: DataFrame) -> Registry:
    """Registers rows of RECORD's columns without the digest, and `data`, the weights. Blobs are written before the records."""
    _refuse(rows.groupBy(*KEY).count().where("count > 1"), "registered twice in a batch")
    _refuse(rows.join(_table(reg, "records", RECORD), KEY, "left_semi"), "adapter version already registered")
    blobs = _written(reg, "blobs", rows.select(blob_key().alias("key"), "data"))
    kept = reg.spark.read.schema(BLOB).parquet(f"{reg.folder}/{blobs}").select("key", F.sha2("data", 256).alias("blob_sha256"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    made = rows.drop("blob_sha256", "data").withColumn("key", blob_key()).join(kept, "key", "left")
    return _with(reg, blobs=blobs, records=_written(reg, "records", made.select(*[F.col(n) for n in names])))


def _changed(reg: Registry, changes: DataFrame, at_ms: int) -> Registry:
    """changes: adapter_id, version, status."""
    _refuse(changes.join(_table(reg, "records", RECORD), KEY, "left_anti"), "cannot set status on an unknown adapter")
    rows = changes.select(*KEY, "status", F.lit(at_ms).cast("long").alias("at_ms"), F.lit(reg.version).alias("seq"))
    return _with(reg, changes=_written(reg, "changes", rows))


def with_status(reg: Registry, keys: DataFrame, status: str, at_ms: int) -> Registry:
    return _changed(reg, keys.select(*KEY).distinct().withColumn("status", F.lit(status)), at_ms)


def promoted(reg: Registry, keys: DataFrame, at_ms: int) -> Registry:
    """Makes these versions active and deprecates any other active version of their adapters, in one commit."""
    keys = keys.select(*KEY).distinct()
    _refuse(keys.groupBy("adapter_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n")).where("n > 1"), "two versions of one adapter promoted at once")
    others = records(reg).where("status = 'active'").join(keys, KEY, "left_anti").join(keys.select("adapter_id"), "adapter_id", "left_semi")
    changes = keys.withColumn("status", F.lit("active")).unionByName(others.select(*KEY).withColumn("status", F.lit("deprecated")))
    return _changed(reg, changes, at_ms)


def shadow_refusals(measures: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """measures (adapter_id, version, parametric_faithfulness, baseline_faithfulness) with the reason not to promote, if any."""
    worse = F.col("parametric_faithfulness") < F.col("baseline_faithfulness") - tolerance
    return measures.withColumn("reason", F.when(worse, "shadow_faithfulness_regression"))


def promoted_from_shadow(reg: Registry, measures: DataFrame, at_ms: int, tolerance: float = 0.02) -> tuple[Registry, DataFrame]:
    """Promotes the versions whose shadow traffic shows no regression; also gives all measures with their reasons."""
    judged = shadow_refusals(measures, tolerance)
    return promoted(reg, judged.where("reason is null"), at_ms), judged


def revoked(reg: Registry, documents: DataFrame, at_ms: int) -> tuple[Registry, DataFrame]:
    """Revokes every version trained on any of the documents (document_id); also gives these versions, revoked before or not."""
    taught = _table(reg, "records", RECORD).select(*KEY, F.explode("source_document_ids").alias("document_id"))
    hit = taught.join(documents.select(F.col("document_id").cast("string")).distinct(), "document_id", "left_semi").select(*KEY).distinct()
    affected = records(reg).join(hit, KEY, "left_semi").select(*KEY, "status")
    return with_status(reg, affected.where("status <> 'revoked'"), "revoked", at_ms), affected.select(*KEY)


def servable(reg: Registry, tenants: DataFrame) -> DataFrame:
    """tenant_id and the active versions that may serve it: global ones, and those of its own scope."""
    active = records(reg).where("status = 'active'")
    own = tenants.select("tenant_id").distinct()
    scoped = own.join(active, own["tenant_id"] == active["tenant_scope"]).where(F.col("tenant_id") != GLOBAL)
    return scoped.unionByName(own.crossJoin(active.where(F.col("tenant_scope") == GLOBAL)).select(scoped.columns))  # each global one serves every tenant


def covered(reg: Registry, asked: DataFrame, floor: float = 0.3) -> DataFrame:
    """asked (tenant_id, domain) with whether a servable version covers the domain, and whether one of the tenant's own does."""
    able = servable(reg, asked).where(F.col("weight") >= floor)
    facts = able.groupBy("tenant_id", "domain").agg(F.lit(True).alias("covers"), F.bool_or(F.col("tenant_scope") == F.col("tenant_id")).alias("covers_scoped"))
    return asked.select("tenant_id", "domain").distinct().join(facts, ["tenant_id", "domain"], "left").na.fill(False, ["covers", "covers_scoped"])


def verified(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """wanted (with key and the digest that it must have, blob_sha256) with data, or with why there is none: `error`.
    blobs: key, data. A null digest is a mismatch."""
    rows = wanted.join(blobs.select("key", F.col("data").alias("_data"), F.lit(True).alias("_there")), "key", "left")
    same = F.coalesce(F.sha2("_data", 256) == F.col("blob_sha256"), F.lit(False))
    error = F.when(F.col("_there").isNull(), NOT_FOUND).when(~same, MISMATCH)
    return rows.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), F.col("_data"))).drop("_data", "_there")


def loaded(reg: Registry, keys: DataFrame) -> DataFrame:
    """adapter_id, version, data and error of each key. An unknown key has no blob."""
    known = _table(reg, "records", RECORD).select(*KEY, "blob_sha256")
    wanted = keys.select(*KEY).distinct().join(known, KEY, "left").withColumn("key", blob_key())
    return verified(wanted, _table(reg, "blobs", BLOB)).select(*KEY, "data", "error")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Blobs kept as files: the key is the path below the folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return rows.select(F.substring_index("path", root.split(":", 1)[1] + "/", -1).alias("key"), F.col("content").alias("data"))
