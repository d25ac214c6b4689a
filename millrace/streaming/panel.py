"""The hourly panel as a tumbling-window stream, and fitted row-local steps on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.joins import keyed_join
from ..functions.values import as_list, col
from ..operators.base import Operator
from ..session import materialise

DAY, VERSION = "_day", "_version"


def event_stream(spark: SparkSession, path: str, schema, time_col: str, **options) -> DataFrame:
    """Parquet files as a stream with event time in a type that watermarks accept."""
    files = spark.readStream.schema(schema).options(**options).parquet(path)
    return files.withColumn(time_col, col(time_col).cast("timestamp"))


def hourly_stream(stream: DataFrame, entity: str, time_col: str, measures: dict[str, list[str]],
                  count_name: str = "row_count", delay: str = "1 hour") -> DataFrame:
    """Per entity and hour, as the batch panel; late rows beyond ``delay`` are dropped by the watermark."""
    pick = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    aggs = [pick[f](col(n)).alias(f"{n}_{f}") for n, fs in measures.items() for f in as_list(fs)]
    hours = stream.withWatermark(time_col, delay).groupBy(F.window(col(time_col), "1 hour"), col(entity)) \
        .agg(*aggs, F.count("*").alias(count_name))
    start = F.col("window.start")
    return hours.select(col(entity), start.cast("timestamp_ntz").alias("_hour_ts"),
                        *[col(n) for n in hours.columns if n not in ("window", entity)],
                        F.unix_seconds(start).alias("_hour_idx"))


def write_panel(hours: DataFrame, entity: str, folder: str, checkpoint: str, time_col: str = "_hour_ts", **trigger):
    """Start a query that keeps a panel in ``folder``; every batch writes the days it touches, and nothing else.

    The stream runs in update mode, so a batch holds only the hours that changed and the state ends with the watermark.
    A batch writes its days anew, as a version named by the batch: earlier versions are never touched, so a batch that is
    run again after a failure writes the same rows to the same place.  ``trigger`` as in ``DataStreamWriter.trigger``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, days = batch.sparkSession, F.to_date(col(time_col))
        new = materialise(batch.withColumn(DAY, days))
        if new.isEmpty():
            return
        out, before = new, panel_versions(spark, folder, number)
        if before is not None:
            # The keys and days of one batch: as many as the watermark leaves open, measured before they are sent.
            kept = keyed_join(before, new.select(DAY).distinct(), [DAY], "left_semi")
            kept = keyed_join(kept, new.select(col(entity), col(time_col)), [entity, time_col], "left_anti")
            out = kept.select(*[col(c) for c in new.columns]).unionByName(new)
        out.repartition(DAY).write.mode("overwrite").partitionBy(DAY).parquet(f"{folder}/{VERSION}={number}")

    return hours.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def panel_versions(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The panel's rows: of every day the last version (before the batch ``below``); None if nothing was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    numbers = [int(n.partition("=")[2]) for n in written if n.startswith(f"{VERSION}=")]
    # A folder without the mark is a batch that has not ended.
    paths = [f"{folder}/{VERSION}={n}" for n in sorted(numbers) if (below is None or n < below)
             and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{VERSION}={n}/_SUCCESS"))]
    if not paths:
        return None
    rows = spark.read.option("basePath", folder).parquet(*paths)
    # One row per day.
    last = rows.groupBy(DAY).agg(F.max(VERSION).alias(VERSION))
    return keyed_join(rows, last, [DAY, VERSION], "left_semi").drop(VERSION)


def read_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel as it stands, without the bookkeeping columns."""
    rows = panel_versions(spark, folder)
    if rows is None:
        raise FileNotFoundError(f"no panel in {folder}")
    return rows.drop(DAY)


def apply_fitted(stream: DataFrame, steps: list[Operator]) -> DataFrame:
    """Apply fitted row-local steps to a stream; an unfitted step is an error."""
    for step in steps:
        if step.cross_row or step.uses_history:
            raise ValueError(f"{type(step).__name__} needs other rows and cannot run on a stream")
        if not step.fitted:
            raise ValueError(f"{type(step).__name__} must be fitted on a table first")
        stream = step.transform(stream)
    return stream
