"""Session for local runs and tests. Settings that the submitter has made stay as they are."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
}


def get_session(app_name: str = "counterfact", cores: str | None = None) -> SparkSession:
    """The session of the submitter, or a local one; only what is unset is set."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    submitted = SparkConf()
    builder = SparkSession.builder
    for key, value in {"spark.app.name": app_name, "spark.master": f"local[{cores}]", **LOCAL_SETTINGS}.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    return builder.getOrCreate()
