"""Dense numbering of rows without sending a whole environment through one task.

Rows fall into buckets that keep the order. Rows are counted per bucket, the counts are summed up to
give every bucket its first number, and ``row_number`` runs inside the buckets only. The numbers
equal those of one global ``row_number`` and do not depend on the bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfact.staging import stage

# Rows a bucket should hold.
ROWS_PERBUCKET = 500_000
# Column with the bucket of a row; buckets keep the order.
BUCKET = "_bucket"
_FIRST = "_first"


def bucket_count(spark: SparkSession, n_rows: int) -> int:
    """Number of buckets for a number of rows; enough to use all cores."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PERBUCKET))


def number_in_buckets(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "idx"
) -> DataFrame:
    """Number rows from 0 per group, given an order-keeping ``_bucket`` column.

    The first numbers are one row per group and bucket; the planner sends them to all
    tasks while they are few and joins them otherwise.
    """
    sizes = df.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    firsts = sizes.select(*groups, BUCKET, (F.sum("_n").over(earlier) - F.col("_n")).alias(_FIRST))
    placed = df.join(firsts, [*groups, BUCKET])
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order)
    numbered = placed.withColumn(name, (F.col(_FIRST) + F.row_number().over(inside) - 1).cast("bigint"))
    return numbered.drop(BUCKET, _FIRST)


def shuffled_index(
    df: DataFrame,
    groups: Sequence[str],
    digest: str,
    ties: Sequence[str],
    n_buckets: int,
    name: str = "idx",
) -> DataFrame:
    """Number rows in the order of a hex digest column, which spreads evenly over the buckets."""
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    bucketed = df.withColumn(BUCKET, F.shiftright(head * F.lit(n_buckets), 32))
    return number_in_buckets(bucketed, groups, [digest, *ties], name)


def ranged_index(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str | Column],
    n_rows: int | None = None,
    name: str = "idx",
) -> DataFrame:
    """Number rows per group in any order of columns of any type.

    The rows are split into ranges over the groups and all columns of the order, as many as the number
    of rows asks for, and written once so that the borders cannot move.
    """
    n_buckets = bucket_count(df.sparkSession, df.count() if n_rows is None else n_rows)
    ranged = df.repartitionByRange(n_buckets, *groups, *order).withColumn(BUCKET, F.spark_partition_id())
    return number_in_buckets(stage(ranged, "ranged"), groups, list(order), name)


def sorted_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Number all rows in an order."""
    return ranged_index(df, [], order, name=name)
