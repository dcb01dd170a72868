"""Vocabulary with stable ids, and lines as arrays of ids."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from counterfact import fixed
from counterfact.functions import text
from counterfact.operators.index import sorted_index
from counterfact.staging import stage

# Tasks get the functions of this module by value, without the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNK_ID = fixed.SPECIAL_TOKENS.index(fixed.UNK)
CLS_ID = fixed.SPECIAL_TOKENS.index(fixed.CLS)
SEP_ID = fixed.SPECIAL_TOKENS.index(fixed.SEP)
MASK_ID = fixed.SPECIAL_TOKENS.index(fixed.MASK)
N_SPECIAL = len(fixed.SPECIAL_TOKENS)

# Words that every task knows: the most frequent ones, which are the hot keys of a join.
FREQUENT_WORDS = 50_000
# Words of the lines of a part, about; a task holds the lines of a part at a time.
TOKENS_PER_PART = 500_000
_WORDS, _PART = "_words", "_part"


def line_tokens(lines: DataFrame, *keys: str) -> DataFrame:
    """One row per word: keys, ``pos`` from 0, ``token``."""
    return lines.select(*keys, F.posexplode(text.words(F.col("line"))).alias("pos", "token"))


def token_counts(lines: DataFrame) -> DataFrame:
    """Occurrences of every word."""
    return lines.select(F.explode(text.words(F.col("line"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def build_vocab(lines: DataFrame) -> DataFrame:
    """Rows ``(token, n, token_id)``: special tokens first, then all words by falling count and by name."""
    counts = stage(token_counts(lines), "token_counts")
    numbered = sorted_index(counts, [F.desc("n"), F.asc("token")])
    words = numbered.select("token", "n", (F.col("idx") + N_SPECIAL).alias("token_id"))
    special = lines.sparkSession.createDataFrame(
        [(t, 0, i) for i, t in enumerate(fixed.SPECIAL_TOKENS)], "token string, n bigint, token_id bigint"
    )
    return special.unionByName(words)


def encode_tokens(lines: DataFrame, vocab: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys and ``ids``: the start mark, the id of every word, the end mark.

    The first ``FREQUENT_WORDS`` words of the vocabulary are sent to the tasks. If there are others, the lines are
    dealt into parts, each part's distinct words beyond the frequent ones are joined with the rest of the
    vocabulary, and come back to the part as its own dictionary. So the lines move once, no token moves, and a
    word is a key of the join once a part at most. Words that the vocabulary does not hold are unknown.

    ``keys`` are carried and need not be unique: repeated rows have repeated results. ``vocab`` is best a
    written table, for it is read three times; its counts give the number of parts.
    """
    spark = lines.sparkSession
    words = vocab.where(F.col("token_id") >= N_SPECIAL).select("token", "token_id", "n")
    border = N_SPECIAL + FREQUENT_WORDS
    size = words.agg(F.max("token_id").alias("last"), F.sum("n").alias("tokens")).first()
    frequent = words.where(F.col("token_id") < border).select("token", F.col("token_id").cast("int")).toArrow()
    frequent = frequent.cast(pa.schema([("token", pa.string()), ("token_id", pa.int32())])).combine_chunks()
    table = spark.sparkContext.broadcast(frequent)
    split = lines.select(*keys, text.words(F.col("line")).alias(_WORDS))
    if (size["last"] or 0) < border:
        look_up = F.arrow_udf(lambda words: _to_ids(words, table.value), "array<int>")
        return split.select(*keys, look_up(_WORDS).alias("ids"))
    rest = words.where(F.col("token_id") >= border).select("token", F.col("token_id").cast("int").alias("token_id"))

    # Several parts a task, so that the tasks are about even.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["tokens"] // (8 * TOKENS_PER_PART)))
    parts = 8 * tasks
    # The number of the input's partition is a part of the key, so that rows which repeat are spread too.
    part = F.pmod(F.xxhash64(*keys, _WORDS, F.spark_partition_id()), F.lit(parts)).cast("int")
    dealt = split.withColumn(_PART, part).repartition(tasks, _PART)
    # All columns, as below, so that the lines are taken apart and dealt once for both.
    asked = dealt.mapInArrow(_rare_words(table), f"{_PART} int, token string")
    known = asked.join(rest, "token").select(_PART, "token", "token_id").repartition(tasks, _PART)
    out = StructType([f for f in split.schema.fields if f.name != _WORDS]).add("ids", ArrayType(IntegerType()))
    return dealt.groupBy(_PART).cogroup(known.groupBy(_PART)).applyInArrow(_encode_part(table, out), out)


def _to_ids(words: pa.Array, dictionary: pa.Table, frequent: pa.Table | None = None) -> pa.ListArray:
    """Arrays of words as arrays of ids between the marks; ``frequent`` is looked in first."""
    flat = words.flatten().cast(pa.string())
    ids = pc.fill_null(_look_up(flat, dictionary), UNK_ID)
    if frequent is not None:
        ids = pc.coalesce(_look_up(flat, frequent), ids)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="int32")
    inner = np.ones(len(out), dtype=bool)
    inner[starts] = inner[ends - 1] = False
    out[starts], out[ends - 1] = CLS_ID, SEP_ID
    out[inner] = ids.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype("int32"), pa.array(out))


def _look_up(flat: pa.Array, dictionary: pa.Table) -> pa.Array:
    """Ids of words, null for those that the dictionary does not hold."""
    if not dictionary.num_rows:
        return pa.nulls(len(flat), pa.int32())
    tokens, ids = (dictionary[c].combine_chunks() for c in ("token", "token_id"))
    return pc.take(ids, pc.index_in(flat, value_set=tokens))


def _rare_words(table):
    """Distinct words of a part that are not frequent, one row for each batch of lines that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(_WORDS)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            part = np.repeat(batch.column(_PART).to_numpy(), sizes)
            coded = words.flatten().cast(pa.string()).dictionary_encode()
            rare = _look_up(coded.dictionary, table.value).is_null().to_numpy(zero_copy_only=False)
            at = coded.indices.to_numpy()
            pairs = np.unique(np.stack([part[rare[at]], at[rare[at]]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            arrays = [pa.array(pairs[0], pa.int32()), coded.dictionary.take(pa.array(pairs[1], pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[_PART, "token"])

    return run


def _encode_part(table, out: StructType):
    """Keys and ids of the lines of a part, given its own dictionary."""
    schema = to_arrow_schema(out)

    def run(lines: pa.Table, known: pa.Table) -> pa.Table:
        rare = known.select(["token", "token_id"])
        arrays = [_to_ids(chunk, rare, table.value) for chunk in lines[_WORDS].chunks]
        columns = [lines[name] for name in schema.names[:-1]]
        return pa.table([*columns, pa.chunked_array(arrays, pa.list_(pa.int32()))], names=schema.names).cast(schema)

    return run
