"""Queues as streams: files land, each is processed once, the latest state of each key is kept.

A checkpoint takes the place of a status column: what a failed run has not committed is read again, and no two runs share a
checkpoint. ``availableNow`` works off what is there and ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, folder: str, schema, per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and key; rows later than ``late`` are dropped, closed windows come out once."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count("*").alias("events"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), key, "events", "total")
    )


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of checkpoints, for a stream's state and its rows."""
    from epochgrid.session import shared_folder

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def requeued(queue: DataFrame, status: str, changed: str, before) -> DataFrame:
    """The queue after what was taken before a moment and never finished is pending again."""
    stale = (F.col(status) == "processing") & (F.col(changed) < F.lit(before))
    return queue.withColumn(status, F.when(F.coalesce(stale, F.lit(False)), "pending").otherwise(F.col(status)))


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last in order."""
    best = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.filter(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The whole versions of a state, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    whole = [n for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return sorted(map(int, whole))


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The state that ``keep_latest`` keeps."""
    return spark.read.parquet(f"{target}/{_versions(spark, target)[-1]}")


def keep_latest(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch into the state at ``target``: the next version, a folder of its own; all but the last two versions go.

    To merge a batch twice changes nothing, so a batch that is run again after a failure counts once, and with a new checkpoint
    the state that is there goes on.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = _versions(spark, target)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/{known[-1]}")) if known else batch
        newest(rows, key, order).write.mode("overwrite").parquet(f"{target}/{known[-1] + 1 if known else 0}")
        for old in known[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Without rows that repeat a key within ``late`` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
