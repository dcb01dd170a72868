"""Choice and replacement of tokens for masked training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.draws import digest, digest_below, draw_from
from counterfact.operators.vocab import MASK_ID, N_SPECIAL


def mlm_mask(
    blocks: DataFrame, seed: int, vocab_size: int | Column, keys: tuple[str, ...], share: float = fixed.MASK_SHARE
) -> DataFrame:
    """Add ``labels`` and replace the chosen ids.

    A token is chosen with probability ``share``, special tokens never. Of the chosen, 80 % become
    the mask, 10 % a random id, 10 % stay. One digest per token gives all three draws.
    """
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    # A struct per token, so that the digest is taken once per token and not once per use.
    drawn = F.transform(
        "input_ids",
        lambda x, i: F.struct(x.alias("id"), digest(F.col("_key"), i).alias("d")),
    )

    def chosen(t: Column) -> Column:
        return (t["id"] >= N_SPECIAL) & digest_below(t["d"], share)

    def replaced(t: Column) -> Column:
        random_id = F.floor(draw_from(t["d"], 2) * size).cast("int")
        return F.when(
            chosen(t),
            F.when(digest_below(t["d"], 0.8, 1), F.lit(MASK_ID))
            .when(digest_below(t["d"], 0.9, 1), random_id)
            .otherwise(t["id"]),
        ).otherwise(t["id"])

    def label(t: Column) -> Column:
        return F.when(chosen(t), t["id"]).otherwise(F.lit(fixed.IGNORED_LABEL))

    return (
        blocks.withColumn("_key", key)
        .withColumn("_drawn", drawn)
        .withColumn("labels", F.transform("_drawn", label))
        .withColumn("input_ids", F.transform("_drawn", replaced))
        .drop("_drawn", "_key")
    )
