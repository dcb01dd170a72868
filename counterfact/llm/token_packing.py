"""Token ids packed into rows of one length, best fit first, decreasing.

Each text is encoded and closed with an end token. Texts longer than a row are split without loss: whole rows
go out as they are, the rest is a piece like any other. The pieces of a window are sorted by length, longest
first, and each goes into the open row with the least room that still holds it; a segment tree over the rooms
from zero to the length of a row finds that row. A row of the result is a row of the id matrix with its
cumulative segment lengths, the places at which positions start again, and the segments themselves.

Windows are cut from the rows of a partition as they come, up to a number of tokens, so nothing is shuffled,
memory is bounded and no key can be hot. What is lost by this is the room left in the last rows of a window.

Defined cases: a null or empty text is its end token alone; repeated rows and ids are packed one by one; rows
without an id are packed, with a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from counterfact.llm.batches import parts, quoted
from counterfact.llm.bpe_automaton import PART_BYTES, Automaton, SpecialSplit, compile_tokenizer, encode_texts
from counterfact.llm.shipping import ship


@dataclass(frozen=True)
class Layout:
    """Tokens of a row and of a window, end and padding token."""

    length: int = 2048
    window: int = 4_000_000
    end: int = 49407
    pad: int = 49407


class RoomTree:
    """Open rows by their room; a segment tree knows the least room of at least a size that has a row."""

    def __init__(self, length: int):
        self.leaves = 1
        while self.leaves <= length:
            self.leaves *= 2
        self.full = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.full[node]:
            self.full[node] = 1
            node //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """The room and number of the fullest row that holds ``size``; the row is taken out."""
        node = size + self.leaves
        if not self.full[node]:
            # Up to the first node whose right neighbour has a row, then down its left side.
            while node > 1 and (node & 1 or not self.full[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.full[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.full[node] = 0
            node //= 2
            while node and not (self.full[2 * node] or self.full[2 * node + 1]):
                self.full[node] = 0
                node //= 2
        return room, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces of each row: the longest first, each into the fullest row that holds it."""
    tree = RoomTree(length)
    rows: list[list[int]] = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = tree.take(size)
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > size:
            tree.add(room - size, row)
    return rows


def _split(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token and size of all pieces of the texts."""
    sizes = np.diff(bounds)
    count = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = number * length
    return text, first, np.minimum(length, sizes[text] - first)


def _with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the end token behind each."""
    wider = bounds + np.arange(len(bounds))
    out = np.full(int(wider[-1]), end, np.int32)
    inner = np.ones(len(out), bool)
    inner[wider[1:] - 1] = False
    out[inner] = ids
    return out, wider


def pack_texts(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", layout: Layout = Layout()
) -> DataFrame:
    """Rows of the packed id matrix: (shard, row, ids, n_used, cu_seqlens, resets, segments).

    ``ids`` has ``layout.length`` little-endian unsigned 32-bit numbers; ``cu_seqlens`` begins with 0 and ends
    with ``n_used``; positions start again at ``resets``; a segment is (id, first_token, start, length).
    """
    ship(df.sparkSession)
    automaton = compile_tokenizer(tokenizer)
    inputs = df.select(F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(id_col)).alias("id"))
    segment = (
        StructType()
        .add("id", inputs.schema["id"].dataType)
        .add("first_token", LongType())
        .add("start", IntegerType())
        .add("length", IntegerType())
    )
    out = (
        StructType()
        .add("shard", IntegerType())
        .add("row", LongType())
        .add("ids", BinaryType())
        .add("n_used", IntegerType())
        .add("cu_seqlens", ArrayType(IntegerType()))
        .add("resets", ArrayType(IntegerType()))
        .add("segments", ArrayType(segment))
    )
    return inputs.mapInArrow(lambda batches: _packed(batches, automaton, layout, to_arrow_schema(out)), out)


def _packed(
    batches: Iterator[pa.RecordBatch], automaton: Automaton, layout: Layout, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    split = SpecialSplit(automaton.specials)
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    tokens = made = 0
    for batch in batches:
        for part in parts(batch, 0, PART_BYTES):
            ids, bounds = _with_end(*encode_texts(part.column(0), automaton, split), layout.end)
            held.append((ids, bounds, part.column(1)))
            tokens += len(ids)
            if tokens >= layout.window:
                for rows in _window(held, shard, made, layout, schema):
                    made += rows.num_rows
                    yield rows
                held, tokens = [], 0
    if held:
        yield from _window(held, shard, made, layout, schema)


def _window(
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]], shard: int, made: int, layout: Layout, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Rows of one window, some hundred at a time."""
    ids = np.concatenate([i for i, _, _ in held])
    sizes = np.concatenate([np.diff(b) for _, b, _ in held])
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    names = pa.concat_arrays([n for _, _, n in held])
    text, first, size = _split(bounds, layout.length)
    rows = best_fit(size, layout.length)
    for start in range(0, len(rows), 512):
        some = rows[start : start + 512]
        matrix = np.full((len(some), layout.length), layout.pad, "<u4")
        lengths, pieces = [], []
        for line, row in zip(matrix, some):
            at = [0]
            for piece in row:
                begin, n = int(bounds[text[piece]] + first[piece]), int(size[piece])
                line[at[-1] : at[-1] + n] = ids[begin : begin + n]
                at.append(at[-1] + n)
            lengths.append(at)
            pieces += row
        chosen = np.array(pieces)
        segments = pa.StructArray.from_arrays(
            [
                names.take(pa.array(text[chosen])),
                pa.array(first[chosen], pa.int64()),
                pa.array([x for at in lengths for x in at[:-1]], pa.int32()),
                pa.array(size[chosen], pa.int32()),
            ],
            fields=list(schema.field("segments").type.value_type),
        )
        firsts = np.concatenate([[0], np.cumsum([len(row) for row in some])])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * len(some), pa.int32()),
                pa.array(range(made + start, made + start + len(some)), pa.int64()),
                pa.array([line.tobytes() for line in matrix], pa.binary()),
                pa.array([at[-1] for at in lengths], pa.int32()),
                pa.array(lengths, pa.list_(pa.int32())).cast(schema.field("cu_seqlens").type),
                pa.array([at[:-1] for at in lengths], pa.list_(pa.int32())).cast(schema.field("resets").type),
                pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), segments).cast(schema.field("segments").type),
            ],
            schema=schema,
        )


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the id matrix, cumulative lengths and resets as Parquet, rows in order within a shard's file."""
    packed.write.mode("overwrite").parquet(path)


def read_segments(packed: DataFrame) -> DataFrame:
    """Rows (id, first_token, ids) of all pieces, from packed rows; pieces in order make up the texts."""
    each = packed.select("ids", F.inline("segments"))
    piece = F.substring(F.col("ids"), F.col("start") * 4 + 1, F.col("length") * 4)
    return each.select("id", "first_token", piece.alias("ids"))
