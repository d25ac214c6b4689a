"""Session helpers: a tuned local session, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "millrace", master: str | None = None,
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC time on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for durable intermediate tables.

    The session's ``spark.checkpoint.dir`` names it.  Only a local master may
    fall back to a folder of this machine; a cluster without the setting is an
    error, because its executors could not read such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-millrace-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# The lists of tables of the scopes that the running code is in; other threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("table_scopes", default=())


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`materialise` writes inside, at the end.

    What is to outlive the scope must have been written or collected by then.
    """
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts lineage and fixes values that depend on partition layout.  The table
    outlives lost executors, keeps column pruning, and gives the optimiser real
    file sizes.  With ``keep`` it outlives the scope it is written in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    for made in () if keep else _scopes.get():
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
