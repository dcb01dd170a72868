"""Whether a key may be in a set, without moving the rows that ask.

The set becomes a bitmap of a fixed size: a bit for the hash of each member. A key whose bit is not set is
certainly not in the set; any other has to be looked up exactly. The bitmap has the same size however many
members there are; a fuller one only sends more rows to the exact lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map, a power of two: 8 MB.
BITS = 1 << 26


def may_hold(members: DataFrame, key: str):
    """Function from a key column to whether the key may be among the members; true for null.

    The bitmap is put together by Spark; the driver gets its words, 8 MB of them at most, and sends them to
    the tasks.
    """
    spark = members.sparkSession
    slot = _slot(F.col(key))
    words = members.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))).alias("bits")
    )
    table = words.toArrow()
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def look_up(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        bit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(bit.astype(bool))

    found = F.arrow_udf(look_up, "boolean")

    def column(asked: Column) -> Column:
        return asked.isNull() | found(F.coalesce(_slot(asked), F.lit(0).cast("bigint")))

    return column


def _slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(BITS - 1).cast("bigint"))
