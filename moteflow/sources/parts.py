"""Derived tables kept as stamped parts that are replaced as a whole.

A store is a folder. ``data/run=<id>/part=<name>`` holds rows, and ``manifest/<number>`` names the run that is valid for every part with the stamp it was made from. A writer adds
a run beside what is there and then puts a new manifest in place by one rename, so readers see all of an update or nothing of it, a writer that dies
changes nothing, and a stale part is replaced. Two writers at once: the rename of the second fails, since its manifest number is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "part string, stamp string, run string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _last(spark: SparkSession, store: str) -> int:
    return max([int(n) for n in _children(spark, f"{store}/manifest") if n.isdigit()], default=0)


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """(part, stamp, run) of the newest manifest; empty for a new store."""
    n = _last(spark, store)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/{n}") if n else spark.createDataFrame([], MANIFEST)


def stale_parts(wanted: DataFrame, store: str) -> DataFrame:
    """The rows of ``wanted(part, stamp)`` that the store lacks or holds with another stamp."""
    return wanted.join(read_manifest(wanted.sparkSession, store).select("part", "stamp"), ["part", "stamp"], "left_anti")


def replace_parts(rows: DataFrame, stamps: DataFrame, store: str) -> None:
    """Make ``rows(part, ...)`` the content of the parts in ``stamps(part, stamp)``, also of those that have no row; other parts stay. Rows of parts that are not in ``stamps`` are refused."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    n = _last(spark, store)
    rows.join(stamps.select("part"), "part", "left_anti").limit(1).collect() and _refuse()
    rows.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{store}/data/run={run}")
    kept = read_manifest(spark, store).join(stamps.select("part"), "part", "left_anti")
    kept.unionByName(stamps.select("part", "stamp", F.lit(run).alias("run"))).write.parquet(f"{store}/manifest/.{run}")
    fs, there = _fs(spark, f"{store}/manifest/{n + 1}")
    if fs.exists(there) or not fs.rename(_fs(spark, f"{store}/manifest/.{run}")[1], there):
        raise RuntimeError("another writer has replaced the manifest; read it again and write what is stale")


def _refuse():
    raise ValueError("rows of parts without a stamp")


def read_parts(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The valid rows of all parts: ``part`` and the columns of ``schema``. Which runs are read follows from the manifest, so Spark prunes the folders of others."""
    manifest = read_manifest(spark, store)
    runs = [r[0] for r in manifest.select("run").distinct().collect()]  # one for each update that still has a valid part
    paths = [f"{store}/data/run={r}" for r in runs if any(c.startswith("part=") for c in _children(spark, f"{store}/data/run={r}"))]
    if not paths:
        return spark.createDataFrame([], f"part string, {schema}")
    data = spark.read.schema(f"{schema}, run string, part string").option("basePath", f"{store}/data").parquet(*paths)
    return data.join(manifest.select("part", "run"), ["part", "run"], "left_semi").select("part", *[c for c in data.columns if c not in ("part", "run")])


def drop_unused(spark: SparkSession, store: str) -> list[str]:
    """Delete the runs that no part of the newest manifest uses, and older manifests; readers of those must have finished. Returns the runs' names."""
    used = {r[0] for r in read_manifest(spark, store).select("run").distinct().collect()}
    gone = [c[4:] for c in _children(spark, f"{store}/data") if c.startswith("run=") and c[4:] not in used]
    n = _last(spark, store)
    for path in [f"{store}/data/run={r}" for r in gone] + [f"{store}/manifest/{c}" for c in _children(spark, f"{store}/manifest") if c != str(n)]:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return sorted(gone)
