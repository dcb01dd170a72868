"""Columns computed from Arrow batches of texts, and the words of a batch as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from counterfact.llm.shipping import ship

#: Bytes of text that a task works on at a time; a longer text is a part of its own.
PART_BYTES = 4 << 20

# The bytes that separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def quoted(name: str) -> str:
    """Name of a column as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(
    buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (one more at the end).

    Words are runs of bytes that are not in ``gap`` (the six ASCII spaces); they end with their text.
    """
    n = len(buf)
    space = np.ones(n + 2, bool)
    np.take(gap, buf, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    inner = offsets[(offsets > 0) & (offsets < n)]
    cut = inner[~space[inner] & ~space[inner + 1]]
    if len(cut):
        cut = np.unique(cut)
        edges = np.sort(np.concatenate([edges, cut, cut]), kind="stable")
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = IS_SPACE) -> pa.Array:
    """The words as an Arrow array of binary values, without a Python object per word."""
    sizes = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    compact = buf[~gap[buf]]
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(compact))]
    )


def word_ids(
    buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, pa.Array]:
    """Number of every word among the distinct words of the batch, and these words. Exact, no hashing."""
    coded = word_array(buf, starts, ends, gap).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def parts(batch: pa.RecordBatch, column: int, part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most so many bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + part_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_text_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], Sequence]],
    out: str | StructType,
    text: str = "text",
    carry: Sequence[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``carry`` columns of ``df`` (all, if not given) with columns computed from its texts.

    ``make`` is called once per task and returns a function from an Arrow array of texts, of ``part_bytes``
    at most, to the arrays of ``out``, in order. A carried column with the name of a computed one gives way to
    it. A column of texts that is not a string is read as one.
    """
    ship(df.sparkSession)
    out_type = out if isinstance(out, StructType) else _parse_datatype_string(out)
    names = [c for c in (df.columns if carry is None else carry) if c not in out_type.names]
    inputs = df.select(
        F.col(quoted(text)).cast("string").alias("_text"),
        *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(names)],
    )
    made = StructType([*inputs.schema.fields[1:]])
    for i, field in enumerate(out_type.fields):
        made = made.add(f"_o{i}", field.dataType)
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in parts(batch, 0, part_bytes):
                columns = fn(part.column(0))
                arrays = [*part.columns[1:], *columns]
                cast = [
                    (a if isinstance(a, pa.Array) else pa.array(a, type=f.type)).cast(f.type)
                    for a, f in zip(arrays, schema, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(cast, schema=schema)
            # A worker lives on; what a batch needed goes back to the system.
            batch = part = columns = arrays = cast = None
            pa.default_memory_pool().release_unused()

    return inputs.mapInArrow(run, made).toDF(*names, *out_type.names)
