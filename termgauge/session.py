"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "termgauge", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def small_batches(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """Jobs that run inside hand Arrow functions batches of about ``size``; a task and its worker each hold one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a ``local`` master may fall back to a temporary folder; on a cluster the executors
    would not see it, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    app = sc.applicationId
    if configured:
        return f"{configured.rstrip('/')}/termgauge-{app}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="termgauge-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors, and every consumer sees the same rows. Values of the columns ``by`` get
    folders of their own, so that readers of one value skip the others.
    """
    return written(df, label, by)[0]


def written(df: DataFrame, label: str, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``materialise`` with the path of the files, for ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of this application that nothing reads any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError("not an intermediate table of this application")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)
