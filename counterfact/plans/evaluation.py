"""Loss and perplexity of the estimators on an evaluation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text
from counterfact.functions.draws import draw_below
from counterfact.functions.measures import perplexity
from counterfact.operators.index import ranged_index
from counterfact.plans.cloze import context_pairs
from counterfact.plans.grid import GridModel
from counterfact.staging import stage

# A key with more than one in so many rows is broadcast, so there are fewer of them than this.
FREQUENT_SHARE = 10_000

CELL_KEYS = ("seed", "p_env_a", "alpha", "method")


def eval_batches(lines: DataFrame, batch_size: int = fixed.EVAL_BATCH_SIZE) -> DataFrame:
    """Lines in corpus order with the number of their batch."""
    numbered = ranged_index(lines, [], ["doc_id", "line_no"])
    return numbered.withColumn("batch", F.floor(F.col("idx") / batch_size).cast("bigint")).drop("idx")


def masked_positions(
    lines: DataFrame, seed: int, share: float = fixed.MASK_SHARE, context: str = "left", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Positions chosen for scoring, with context and word; the others carry no label."""
    pairs = lines.select(
        *keep, "doc_id", "line_no", F.posexplode(context_pairs(text.words(F.col("line")), context)).alias("pos", "_p")
    ).where(F.col("_p.word").isNotNull())
    chosen = draw_below(share, seed, F.col("doc_id"), F.col("line_no"), F.col("pos"))
    return pairs.where(chosen).select(
        *keep, "doc_id", "line_no", "pos", F.col("_p.ctx").alias("ctx"), F.col("_p.word").alias("word")
    )


def position_losses(model: GridModel, positions: DataFrame) -> DataFrame:
    """Negative log-likelihood of every chosen position in every cell of the grid.

    Probabilities are computed per distinct ``(ctx, word)`` and stay one row of it, with an array over the
    cells, until they have met the positions. Equal positions of a batch are counted before.
    """
    keys = [c for c in positions.columns if c not in ("doc_id", "line_no", "pos")]
    counted = stage(positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_positions")), "positions")
    asked = stage(counted.groupBy("ctx", "word").agg(F.count(F.lit(1)).alias("n_rows")), "asked")
    cell = F.struct(*CELL_KEYS, (-F.log("prob")).alias("loss"))
    scored = model.score_words(asked.select("ctx", "word")).groupBy("ctx", "word").agg(
        F.collect_list(cell).alias("cells")
    )
    return join_frequent(counted, stage(scored, "losses"), asked, ["ctx", "word"]).select(
        *keys, "n_positions", F.inline("cells")
    )


def join_frequent(many: DataFrame, one: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows with a table that has one row per key, without sending the rows of a frequent key to one task.

    ``asked`` has the number of rows ``n_rows`` of every key. A key that has more than one in ``FREQUENT_SHARE``
    of all rows is frequent; there are fewer than ``FREQUENT_SHARE`` of these, so their rows of ``one`` are
    broadcast, and all others are joined by a shuffle.
    """
    total = asked.agg(F.sum("n_rows")).first()[0] or 0
    often = F.broadcast(asked.where(F.col("n_rows") * FREQUENT_SHARE > total).select(*keys))
    hot = one.join(often, list(keys), "left_semi")
    return (
        many.join(F.broadcast(hot), list(keys))
        .unionByName(many.join(often, list(keys), "left_anti").join(one, list(keys)))
    )


def masked_cross_entropy(losses: DataFrame) -> DataFrame:
    """Mean loss over the scored positions per cell."""
    n = F.sum("n_positions")
    return losses.groupBy(*CELL_KEYS).agg(
        n.alias("n_positions"), (F.sum(F.col("loss") * F.col("n_positions")) / n).alias("loss")
    )


def model_eval(model: GridModel, lines: DataFrame, seed: int, batch_size: int = fixed.EVAL_BATCH_SIZE) -> DataFrame:
    """Evaluation loss, the unweighted mean of the batch means, its token-weighted counterpart, and
    the perplexity, per cell."""
    batched = eval_batches(lines, batch_size)
    positions = masked_positions(batched, seed, context=model.context, keep=("batch",))
    losses = position_losses(model, positions)
    weighted = F.sum(F.col("loss") * F.col("n_positions"))
    per_batch = losses.groupBy(*CELL_KEYS, "batch").agg(weighted.alias("_s"), F.sum("n_positions").alias("_n"))
    return (
        per_batch.groupBy(*CELL_KEYS)
        .agg(
            F.avg(F.col("_s") / F.col("_n")).alias("eval_loss"),
            (F.sum("_s") / F.sum("_n")).alias("token_loss"),
            F.count(F.lit(1)).alias("n_batches"),
        )
        .withColumn("perplexity", perplexity(F.col("eval_loss")))
    )
