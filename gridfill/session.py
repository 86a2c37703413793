"""Session helpers: a builder with the settings the operators are tuned for, and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridfill", master: str | None = None, checkpoint: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling, Arrow and UTC switched on; `conf` overrides.

    `checkpoint` is the shared folder for intermediate tables (`spark.checkpoint.dir`); every executor must see it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Recording the Python call site of every column expression costs more than planning these queries.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a one-process session (master `local`) uses a folder of its own in its warehouse, removed when the
    process ends; any other master is an error, because its executors would not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    folder = os.path.join("/" + warehouse.lstrip("/"), f"gridfill-{spark.sparkContext.applicationId}")
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


_OWN: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder that holds all intermediate tables of this application."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridfill/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the checkpoint folder and read it back.

    Cuts the lineage of iterative operators, survives lost executors, and gives Catalyst the real
    size of the table, so it broadcasts a side only when that size is known to be small.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridfill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` returned, once nothing reads it any more."""
    path = getattr(df, "_gridfill_path", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries now. It does so only when the driver collects garbage, which a
    driver with little work does long after the disks of the executors have filled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them must be written first."""
    _delete(spark, run_folder(spark))
