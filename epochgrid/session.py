"""Session helpers: nothing here is needed when a cluster hands over its own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "epochgrid", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder of this machine is used, and removed at the end.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = spark.sparkContext.master.split("[")[0] == "local"
        if named is None and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="epochgrid-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    For the rounds of a loop: a checkpoint keeps its plan's estimate of size, and joins of such estimates multiply each round,
    until the planner spends its time on numbers of millions of digits. A table's size is known.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    """Tasks that run at once, as far as the session knows."""
    return max(1, spark.sparkContext.defaultParallelism)
