"""Summary of bias scores per setting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bias_summary(scores: DataFrame, keys: Sequence[str] = ("p_env_a", "lr", "method")) -> DataFrame:
    """Lines, mean and sample deviation of the bias; NaN is no score. One line has no deviation."""
    value = F.nanvl(F.col("bias"), F.lit(None).cast("double"))
    return scores.groupBy(*keys).agg(
        F.count(value).alias("n_scored"), F.avg(value).alias("mean_bias"), F.stddev_samp(value).alias("std_bias")
    )


def scored_count(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of scored lines per run."""
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scored"))


def ordered_summary(summary: DataFrame, keys: Sequence[str] = ("p_env_a", "lr", "method")) -> DataFrame:
    """Summary rows in the order of their keys."""
    return summary.orderBy(*keys)


def plot_series(summary: DataFrame, keys: Sequence[str] = ("lr", "method")) -> DataFrame:
    """One series of ``(p_env_a, mean_bias, std_bias)``, ordered by p, per line of the chart. The
    summary has one row per setting, so a series is as long as the list of p."""
    point = F.struct("p_env_a", "mean_bias", "std_bias")
    return summary.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("series"))


def missing_cells(cells: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells without data, which are skipped and reported."""
    return cells.join(present.select(*keys).distinct(), list(keys), "left_anti")


def pending_runs(cells: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that are not completed; a cell is completed by its success mark, not by its folder."""
    return cells.join(completed.select(*keys).distinct(), list(keys), "left_anti")
