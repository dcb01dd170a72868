"""Analysis of step logs and evaluation logs of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.measures import unguarded_perplexity

# Steps a window task may hold; longer runs are cut into stretches of this length.
STRETCH = 10_000
# Rows of one step come in the order of their loss, so that ties have one answer.
_IN_ORDER = ("step", "loss")


def epoch_env_loss(log: DataFrame, envs: Sequence[str]) -> DataFrame:
    """Mean loss and number of updates per epoch and named environment; NULL and 0 without updates."""
    found = log.groupBy("epoch", "env").agg(F.avg("loss").alias("avg_loss"), F.count("loss").alias("n_updates"))
    names = F.explode(F.array(*[F.lit(e) for e in envs])).alias("env")
    cells = found.select("epoch").distinct().select("epoch", names)
    return cells.join(found, ["epoch", "env"], "left").select(
        "epoch", "env", "avg_loss", F.coalesce("n_updates", F.lit(0)).alias("n_updates")
    )


def round_loss(log: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """Mean loss per round, 0 without updates. ``rounds`` lists the rounds ``(epoch, round)`` that were run."""
    found = log.groupBy("epoch", "round").agg(F.avg("loss").alias("avg_loss"))
    if rounds is not None:
        found = rounds.select("epoch", "round").distinct().join(found, ["epoch", "round"], "left")
    return found.select("epoch", "round", F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"))


def batch_mean_loss(losses: DataFrame) -> DataFrame:
    """One row: unweighted mean of the batch means, and the mean over tokens beside it."""
    per_batch = losses.groupBy("batch").agg(
        F.avg("loss").alias("_mean"), F.sum("loss").alias("_sum"), F.count("loss").alias("_n")
    )
    return per_batch.agg(
        F.coalesce(F.avg("_mean"), F.lit(0.0)).alias("eval_loss"),
        F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_n")), F.lit(0.0)).alias("token_loss"),
        F.count("_mean").alias("n_batches"),
    )


def running_epoch_loss(log: DataFrame, keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Mean loss since the start of the epoch, at every step.

    Runs are cut into stretches of steps; sums of earlier stretches are added to the sums inside, so
    no task holds a whole run.
    """
    cut = log.withColumn("_part", F.floor(F.col("step") / STRETCH))
    sums = cut.groupBy(*keys, "_part").agg(F.sum("loss").alias("_s"), F.count("loss").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*_IN_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.col("_s0") + F.coalesce(F.sum("loss").over(inside), F.lit(0.0))
    n = F.col("_c0") + F.count("loss").over(inside)
    return (
        cut.join(starts, [*keys, "_part"])
        .withColumn("running_loss", F.try_divide(total, n))
        .drop("_part", "_s0", "_c0")
    )


def loss_by_step_interval(log: DataFrame, interval: int = fixed.LOG_INTERVAL) -> DataFrame:
    """Running loss at every step that is a multiple of the interval."""
    return running_epoch_loss(log).where(F.col("step") % interval == 0)


def improvements(evals: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Rows whose loss is strictly below every earlier loss of the run."""
    known = evals.where(F.col("loss").isNotNull()).withColumn("_part", F.floor(F.col("step") / STRETCH))
    lows = known.groupBy(*keys, "_part").agg(F.min("loss").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lows.select(*keys, "_part", F.min("_low").over(before).alias("_low0"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*_IN_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    best = F.least(F.col("_low0"), F.min("loss").over(inside))
    return (
        known.join(starts, [*keys, "_part"])
        .withColumn("_best", F.coalesce(best, F.lit(float("inf"))))
        .where(F.col("loss") < F.col("_best"))
        .drop("_part", "_low0", "_best")
    )


def best_checkpoint(evals: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Step and loss of the best row of every run: the first one with the smallest loss."""
    known = evals.where(F.col("loss").isNotNull())
    best = F.min(F.struct("loss", "step"))
    return known.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.step", "b.loss")


def loss_history(log: DataFrame, envs: Sequence[str]) -> DataFrame:
    """Mean loss with one row per epoch, counted from 1, and one column per environment; NULL without data."""
    wide = log.groupBy("epoch").pivot("env", list(envs)).agg(F.avg("loss"))
    return wide.withColumn("epoch", F.col("epoch") + 1)


def round_log(
    log: DataFrame, val_loss: DataFrame, interval: int = fixed.LOG_INTERVAL, keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Log rows of a per-environment run: at the end of a round whose last step is a multiple of the interval,
    with the mean loss of the round."""
    rounds = log.groupBy(*keys, "epoch", "round").agg(
        F.max("step").alias("global_step"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("train_loss")
    )
    return _log_rows(rounds.where(F.col("global_step") % interval == 0), val_loss)


def training_log(log: DataFrame, val_loss: DataFrame | None = None, interval: int = fixed.LOG_INTERVAL) -> DataFrame:
    """Log rows of a pooled run: at the logged steps, with the mean loss since the start of the epoch."""
    rows = loss_by_step_interval(log, interval).select(
        "run", "epoch", F.col("step").alias("global_step"), F.col("running_loss").alias("train_loss")
    )
    return _log_rows(rows, val_loss)


def _log_rows(rows: DataFrame, val_loss: DataFrame | None) -> DataFrame:
    """Rows ``(run, epoch, global_step, train_loss, val_loss, perplexity)``, epochs counted from 1."""
    if val_loss is None:
        rows = rows.withColumn("val_loss", F.lit(None).cast("double"))
    else:
        rows = rows.join(val_loss, ["run", "global_step"], "left")
    return rows.withColumn("perplexity", unguarded_perplexity(F.col("val_loss"))).select(
        "run", (F.col("epoch") + 1).alias("epoch"), "global_step", "train_loss", "val_loss", "perplexity"
    )
