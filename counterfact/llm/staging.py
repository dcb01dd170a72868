"""Tables written between the stages of an operator, and checks of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from counterfact.staging import new_folder, stage

__all__ = ["stage", "stage_compact", "rows_for", "partitions_for"]


def stage_compact(df: DataFrame, label: str) -> DataFrame:
    """As ``stage``, for large tables: smaller files that take longer to write."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_for(n_rows: int, rows_each: int, least: int = 1) -> int:
    """Number of partitions so that each holds about ``rows_each`` rows."""
    return max(least, -(-n_rows // rows_each))


def partitions_for(df: DataFrame, n_rows: int, rows_each: int) -> int:
    """As ``rows_for``, and at least the session's number of shuffle partitions."""
    return rows_for(n_rows, rows_each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
