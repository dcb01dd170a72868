"""A bounded sample of ids by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact.llm.batches import quoted


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    text = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(by))


def bucket_sample(df: DataFrame, id_col: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``buckets`` ids for each value of ``by``: the least id of every bucket of the id's hash.

    Every id is looked at, and rows are combined on the map side, so no group is gathered.
    """
    ident = F.col(quoted(id_col))
    bucket = F.pmod(F.xxhash64(ident), F.lit(buckets)).alias("_bucket")
    grouped = df.where(ident.isNotNull()).groupBy(*map(quoted, by), bucket)
    return grouped.agg(F.min(ident).alias(id_col)).drop("_bucket")
