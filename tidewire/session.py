"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewire", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every result here is defined under (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session of one machine (tests) gets a folder
    of its own; on a cluster that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), "tidewire-shared")
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a written intermediate table."""
    return f"{shared_dir(spark)}/tidewire/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a written table in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the intermediate tables below the shared folder; for the owner of a session whose results are stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewire")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once a session: they need it for the Arrow functions.

    The archive is written beside the driver and served by Spark; nothing on an executor reads a local folder.
    """
    context = spark.sparkContext
    if getattr(context, "_tidewire_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidewire-ship-")
    archive = shutil.make_archive(os.path.join(folder, "tidewire-package"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    context._tidewire_shipped = True
