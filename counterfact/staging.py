"""Tables written between stages, in the shared folder the cluster names.

A staged table cuts the lineage and survives the loss of executors. The folder is
``spark.checkpoint.dir``; only a local master may fall back to a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="counterfact-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a fresh folder below the staging root."""
    return f"{staging_root(spark)}/counterfact/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
