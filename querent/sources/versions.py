"""Versions of a state kept in a folder, committed by compare-and-swap.

Each version is one small JSON file. A commit writes a file aside and renames it to the next number, never over one that is
there: of two writers who read the same version one fails with Conflict and starts again from the new one. Readers see
whole versions only, and old ones stay readable. The rename is as atomic as the file system's (HDFS and local disks are).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else committed a version after the one that this change was made from."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The last version and its state; 0 and an empty state where there is none."""
    at = _path(spark, f"{folder}/_versions")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return 0, {}
    names = [s.getPath().getName() for s in files.listStatus(at)]
    numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
    return (n := max(numbers), at_version(spark, folder, n)) if numbers else (0, {})


def at_version(spark: SparkSession, folder: str, version: int) -> dict:
    at = _path(spark, f"{folder}/_versions/v{version:012d}.json")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, base: int, state: dict) -> int:
    """Makes `state` the version after `base`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside, to = _path(spark, f"{folder}/_versions/.{uuid.uuid4().hex}"), _path(spark, f"{folder}/_versions/v{base + 1:012d}.json")
    files = aside.getFileSystem(conf)
    aside, to = files.makeQualified(aside), files.makeQualified(to)
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    one = spark.sparkContext._gateway.new_array(how, 1)
    one[0] = how.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, to, one)
    except Py4JJavaError as e:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{folder} has a version {base + 1} already") from None
        raise
    return base + 1
