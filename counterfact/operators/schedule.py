"""Batches, schedules and step arithmetic of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.draws import digest
from counterfact.operators.index import BUCKET, bucket_count, number_in_buckets, shuffled_index, sorted_index
from counterfact.staging import stage

# Environments that are sent to all tasks.
FEW_ENVS = 100_000
_TURN, _EXAMPLE, _DIGEST = ["epoch", "env"], ["doc_id", "line_no"], "_digest"
# Values of the first 15 digits of a digest.
_HEADS = float(1 << 60)


def round_plan(
    sizes: DataFrame,
    batch_size: int = fixed.BATCH_SIZE,
    accumulation: int = fixed.ACCUMULATION,
    nb_steps: int | None = fixed.STEPS_PER_RUN,
    num_epochs: int | None = None,
) -> DataFrame:
    """One row with rounds and steps per epoch, epochs and the step limit of a per-environment run.

    The accumulation only makes rounds fewer. Rounds are 0 where the smallest environment cannot
    fill one; epochs and steps are then NULL.
    """
    check_steps(nb_steps, num_epochs)
    base = sizes.agg(
        F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_size"), F.count(F.lit(1)).alias("n_env")
    ).withColumn("rounds", F.floor(F.col("min_size") / (accumulation * batch_size)).cast("bigint"))
    return _with_epochs(base.withColumn("steps_per_epoch", F.col("rounds") * F.col("n_env")), nb_steps, num_epochs)


def pooled_plan(
    sizes: DataFrame,
    batch_size: int = fixed.BATCH_SIZE,
    accumulation: int = fixed.ACCUMULATION,
    nb_steps: int | None = fixed.STEPS_PER_RUN,
    num_epochs: int | None = None,
) -> DataFrame:
    """One row like ``round_plan`` for a run on the pooled lines."""
    check_steps(nb_steps, num_epochs)
    base = sizes.agg(F.sum("n").alias("n_examples")).withColumn(
        "n_batches", F.ceil(F.col("n_examples") / batch_size).cast("bigint")
    )
    steps = base.withColumn("steps_per_epoch", F.floor(F.col("n_batches") / accumulation).cast("bigint"))
    return _with_epochs(steps, nb_steps, num_epochs)


def check_steps(nb_steps: int | None, num_epochs: int | None) -> None:
    """Reject a run without steps and without epochs."""
    if nb_steps is None and num_epochs is None:
        raise ValueError("either steps or epochs must be given")


def run_config_check(
    env_names: Sequence[str], sizes: DataFrame, nb_steps: int | None = None, num_epochs: int | None = None
) -> DataFrame:
    """Sizes of the environments of a valid configuration; an error otherwise."""
    check_steps(nb_steps, num_epochs)
    if not env_names:
        raise ValueError("no training source given")
    named = sizes.where(F.col("env").isin(list(env_names)))
    if named.where(F.col("n") > 0).isEmpty():
        raise ValueError("all training environments are empty")
    return named


def examples_seen(plan: DataFrame, batch_size: int = fixed.BATCH_SIZE, accumulation: int = fixed.ACCUMULATION) -> DataFrame:
    """Examples a run goes through according to its plan."""
    return plan.withColumn("examples_seen", F.col("max_steps") * (batch_size * accumulation))


def shuffled_batches(
    examples: DataFrame, seed: int, n_rows: int, epochs: int = 1, batch_size: int = fixed.BATCH_SIZE
) -> DataFrame:
    """Random order of all examples of every environment, drawn anew per epoch, cut into batches."""
    keyed = _drawn(examples, seed, epochs)
    n_buckets = bucket_count(examples.sparkSession, n_rows * epochs)
    return _batched(shuffled_index(keyed, _TURN, _DIGEST, _EXAMPLE, n_buckets), batch_size)


def first_batches(
    examples: DataFrame,
    sizes: DataFrame,
    seed: int,
    epochs: int,
    batches: int,
    last_batches: int,
    batch_size: int = fixed.BATCH_SIZE,
) -> DataFrame:
    """The first batches of ``shuffled_batches``: so many of every epoch, and fewer of the last one.

    Only examples whose digest is below a cut are kept and moved. The cut of an environment follows from its
    size ``n``: about as many digests are below it as are needed, and some more. The examples kept are counted;
    where an environment is short of what it needs, the cut is made wider and taken again.
    """
    needed = F.when(F.col("epoch") == epochs - 1, F.lit(last_batches)).otherwise(F.lit(batches)) * batch_size
    filled = sizes.where(F.col("n") > 0)
    every, last = (F.sum(F.least("n", F.lit(k * batch_size).cast("bigint"))) for k in (batches, last_batches))
    total = filled.agg((every * (epochs - 1) + last).alias("wanted"), F.max("n").alias("largest")).first()
    keyed = _drawn(_with_sizes(examples, filled.select("env", "n")), seed, epochs)
    width = 1.0
    while True:
        more = needed + 6 * F.sqrt(needed) + 16
        cut = F.least(F.lit(1.0), width * more / F.col("n")) * _HEADS
        head = F.conv(F.substring(_DIGEST, 1, 15), 16, 10).cast("bigint")
        kept = stage(keyed.withColumn("_head", head).withColumn("_cut", cut).where("_head < _cut").drop("n"), "drawn")
        have = kept.groupBy(*_TURN).agg(F.count(F.lit(1)).alias("n"))
        found = have.agg(F.sum(F.least("n", needed)).alias("needed"), F.sum("n").alias("n")).first()
        # A cut that is wider than the largest environment keeps everything.
        if (found["needed"] or 0) >= (total["wanted"] or 0) or width >= total["largest"]:
            break
        width *= 4
    # Buckets of equal shares of the digests below the cut, which keep the order.
    n_buckets = bucket_count(examples.sparkSession, found["n"] or 0)
    bucket = F.floor(F.col("_head") / F.col("_cut") * n_buckets)
    numbered = number_in_buckets(kept.withColumn(BUCKET, bucket), _TURN, [_DIGEST, *_EXAMPLE])
    return _batched(numbered.where(F.col("idx") < needed).drop("_head", "_cut"), batch_size)


def _drawn(examples: DataFrame, seed: int, epochs: int) -> DataFrame:
    """Every example in every epoch, with the digest that gives its place."""
    keyed = examples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return keyed.withColumn(_DIGEST, digest(seed, F.col("epoch"), F.col("env"), F.col("doc_id"), F.col("line_no")))


def _batched(numbered: DataFrame, batch_size: int) -> DataFrame:
    return numbered.drop(_DIGEST).withColumn("batch_no", F.floor(F.col("idx") / batch_size).cast("bigint"))


def _with_sizes(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with the columns of their environment. The environments are sent to all tasks up to a number of
    them; beyond it the planner joins them."""
    few = sizes.limit(FEW_ENVS + 1).count() <= FEW_ENVS
    return df.join(F.broadcast(sizes) if few else sizes, "env")


def plan_row(plan: DataFrame):
    """The single row of a plan; an error where a run would have no step."""
    row = plan.first()
    if not row.steps_per_epoch:
        raise ValueError("the smallest environment does not fill one round")
    return row


def round_robin_schedule(
    examples: DataFrame,
    sizes: DataFrame,
    seed: int,
    nb_steps: int | None = fixed.STEPS_PER_RUN,
    num_epochs: int | None = None,
    batch_size: int = fixed.BATCH_SIZE,
    accumulation: int = fixed.ACCUMULATION,
) -> DataFrame:
    """Steps that visit the environments in turn: in round r, batch r of each, in order of name.

    An environment without examples has no turn: the plan counts the others only. There may be any number of
    environments. What is moved and sorted are the examples of the steps, however many epochs the smallest
    environment makes them last and however large the others are.
    """
    filled = stage(sizes.where(F.col("n") > 0).select("env", "n"), "sizes")
    if filled.isEmpty():
        raise ValueError("all training environments are empty")
    plan = plan_row(round_plan(filled, batch_size, accumulation, nb_steps, num_epochs))
    # Epochs that begin before the limit, and the rounds that the last of them begins.
    epochs = min(plan.epochs, -(-plan.max_steps // plan.steps_per_epoch))
    rest = plan.max_steps - (epochs - 1) * plan.steps_per_epoch
    last = min(plan.rounds, -(-rest // plan.n_env))
    batches = first_batches(examples, filled, seed, epochs, plan.rounds, last, batch_size)
    if plan.n_env <= FEW_ENVS:
        turns = filled.select("env", (F.row_number().over(Window.orderBy("env")) - 1).alias("_turn"))
    else:
        turns = sorted_index(filled.select("env"), ["env"], "_turn")
    step = (F.col("epoch") * plan.rounds + F.col("batch_no")) * plan.n_env + F.col("_turn") + 1
    placed = _with_sizes(batches, turns).withColumn("round", F.col("batch_no")).withColumn("step", step)
    return step_limit(placed.drop("_turn"), plan.max_steps)


def pooled_schedule(
    examples: DataFrame,
    sizes: DataFrame,
    seed: int,
    nb_steps: int | None = fixed.STEPS_PER_RUN,
    num_epochs: int | None = None,
    batch_size: int = fixed.BATCH_SIZE,
    accumulation: int = fixed.ACCUMULATION,
) -> DataFrame:
    """Steps over the batches of the pooled lines, whole passes until the step limit."""
    sizes = stage(sizes.select("env", "n"), "sizes")
    plan = plan_row(pooled_plan(sizes, batch_size, accumulation, nb_steps, num_epochs))
    epochs = min(plan.epochs, -(-plan.max_steps // plan.n_batches))
    last = min(plan.n_batches, plan.max_steps - (epochs - 1) * plan.n_batches)
    batches = first_batches(examples, sizes, seed, epochs, plan.n_batches, last, batch_size)
    step = F.col("epoch") * plan.n_batches + F.col("batch_no") + 1
    return step_limit(batches.withColumn("step", step), plan.max_steps)


def step_limit(steps: DataFrame, max_steps: int | Column) -> DataFrame:
    """Steps up to the limit."""
    return steps.where(F.col("step") <= max_steps)


def rank_shards(numbered: DataFrame, world_size: int) -> DataFrame:
    """Examples strided over ranks by their number."""
    return numbered.withColumn("rank", F.pmod(F.col("idx"), F.lit(world_size)).cast("int"))


def log_steps(
    schedule: DataFrame, interval: int = fixed.LOG_INTERVAL, n_env: int | None = None, max_steps: int | None = None
) -> DataFrame:
    """Steps at which a run is logged; with ``n_env``, only steps that end a round.

    The step limit ``max_steps`` cuts a round short and so ends it too.
    """
    steps = schedule.select("epoch", "step").distinct().where(F.col("step") % interval == 0)
    if n_env is None:
        return steps
    ends = F.col("step") % n_env == 0
    return steps.where(ends if max_steps is None else ends | (F.col("step") == max_steps))


def checkpoint_steps(schedule: DataFrame, every: int) -> DataFrame:
    """Steps at which heads or models are saved; none when ``every`` is 0."""
    steps = schedule.select("epoch", "step").distinct()
    return steps.where(F.col("step") % every == 0) if every > 0 else steps.where(F.lit(False))


def _with_epochs(base: DataFrame, nb_steps: int | None, num_epochs: int | None) -> DataFrame:
    per_epoch = F.when(F.col("steps_per_epoch") > 0, F.col("steps_per_epoch"))
    if nb_steps is not None:
        epochs = F.greatest(F.lit(1), F.ceil(F.lit(nb_steps) / per_epoch)).cast("bigint")
        return base.withColumn("epochs", F.when(per_epoch.isNotNull(), epochs)).withColumn(
            "max_steps", F.when(per_epoch.isNotNull(), F.lit(nb_steps).cast("bigint"))
        )
    return base.withColumn("epochs", F.when(per_epoch.isNotNull(), F.lit(num_epochs).cast("bigint"))).withColumn(
        "max_steps", per_epoch * num_epochs
    )
