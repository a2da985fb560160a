"""Cutting lineage in loops, in the folder that all executors share, and sending this package to Python workers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session that names none gets a temporary one; on a cluster that is an error, as
    executors could not read each other's files.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = path or "file://" + tempfile.mkdtemp(prefix="churnlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that several readers share it and each prunes its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/churnlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, which it does once the driver has collected its garbage.

    The first collection lets go of the plans, and the second, a little later, of their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: sends it along once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_churnlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="churnlens-"), "churnlens_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._churnlens_shipped = True
