"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def local_session(cpus: int | str = "*", app: str = "moteflow") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's session is used as it is."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> str:
    """Give this package to the executors of a running session whose nodes do not have it installed: a zip of its sources is added to the session. Returns the zip's path."""
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="moteflow-")) / "moteflow.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.addArtifacts(str(archive), pyfile=True)
    return str(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: short lineage that survives
    the loss of executors, and file sizes that adaptive execution can plan with."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/moteflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    if _MADE.get() is not None:
        _MADE.get().append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables. Only for tables that nothing unfinished reads any more: all that was made of them has been written itself."""
    for df in tables:
        path = df.__dict__.pop("_cut_to", None)
        if path is not None:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was ``cut`` inside, except tables handed to the function it gives, which a surrounding ``scratch`` deletes. For steps whose result is cut itself."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    before = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(before)
        discard(*[t for t in made if not any(t is k for k in kept)])
        if _MADE.get() is not None:
            _MADE.get().extend(kept)
