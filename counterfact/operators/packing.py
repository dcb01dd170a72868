"""Packing of encoded lines into blocks of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfact import fixed


def batch_tokens(encoded: DataFrame, batch_rows: int = fixed.MAP_BATCH_ROWS) -> DataFrame:
    """Concatenate the ids of every map batch of consecutive lines; ``idx`` numbers the lines of an
    environment. A group holds at most ``batch_rows`` lines."""
    batched = encoded.withColumn("batch_id", F.floor(F.col("idx") / batch_rows).cast("bigint"))
    return batched.groupBy("env", "batch_id").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("idx", "ids")))["ids"]).alias("ids")
    )


def pack_blocks(encoded: DataFrame, length: int, batch_rows: int = fixed.MAP_BATCH_ROWS) -> DataFrame:
    """Blocks of exactly ``length`` ids; the rest of every batch is dropped."""
    if length < 1:
        raise ValueError("block length must be positive")
    n_blocks = F.floor(F.size("ids") / length).cast("int")
    # The blocks are cut before the explode, so its rows do not carry the ids of the whole batch.
    blocks = F.when(
        n_blocks > 0,
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(F.col("ids"), i * length + 1, length)),
    )
    return batch_tokens(encoded, batch_rows).select(
        "env", "batch_id", F.posexplode(blocks).alias("block_id", "input_ids")
    )


def packing_report(encoded: DataFrame, length: int, batch_rows: int = fixed.MAP_BATCH_ROWS) -> DataFrame:
    """Blocks made and ids dropped per batch, from the array lengths alone."""
    batched = encoded.select(
        "env", F.floor(F.col("idx") / batch_rows).cast("bigint").alias("batch_id"), F.size("ids").alias("n")
    )
    return batched.groupBy("env", "batch_id").agg(
        F.floor(F.sum("n") / length).cast("bigint").alias("n_blocks"),
        F.pmod(F.sum("n"), F.lit(length)).cast("bigint").alias("n_dropped"),
    )
