"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are the words of a text and one end. The context of a token is the word before it, and each word that
anything follows is a restaurant whose customers are the tokens that follow it. Its tables are customers of a
class restaurant: the kind of the word before, which is a word that ends a sentence, a short, a middling or a
long word. The beginning of a text is a class of its own, whose customers are first tokens. The tables of all
classes are the customers of one parent restaurant, whose tables draw words evenly from the vocabulary and one
unknown word. The probability of a token backs off from the word before to its class and to the parent.

The seating of all restaurants is sampled by Gibbs. At first pairs of words are seated customer after customer into
a restaurant without other tables, given the share of the word in the training texts. In a sweep, the customers of
each pair leave and are seated again, one after the other, given the tables of all others in the restaurants of
the words before and what the classes then think of the word without them; after the pairs, the customers of each
word in the classes and the parent do so. The probability of a token is the average of its predictive probabilities
over the sampled seatings of all restaurants. Discounts are estimated from what occurs once and twice.

How the work is spread: texts are cut into blocks, in which every distinct word has a number. For each block,
one entry for each distinct pair is shuffled, never one for each token, packed by ranges of the pair's digest;
so a frequent word's followers are spread over all ranges. A pair is known by 96 bits made of the digests of its words. The draws of a pair come from
its digest, so every block that holds it finds the same tables, and one of them adds these to the sums. A sweep
of the pairs moves those that occur more than once, and no texts: the seating of their words is sent to the
blocks, and what changed in the sums of a word comes back. The vocabulary is cut into parts by the words' digests;
a part and a block exchange one packed row, never one for each word of a block.
Given the totals of the last sweep, the words of a sweep of the classes are independent of each other; so a
sweep is a map over the vocabulary, and the totals are a handful of sums. Its draws come from digests of word,
sweep and customer, so a task that is run again draws the same. Up to 32 customers of a word are seated
singly; of more, groups of one part in 32 are seated at a time with the probability in their middle. The
result goes back to the blocks, where the texts are scored.

Defined cases: a null or empty text is the end alone; repeated rows are learned from and scored one by one;
without training texts every token has the probability of the unknown word; a row without an id is held out;
after a word that training texts do not hold, the class alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructType,
)

from counterfact.llm.batches import LOWER, parts, quoted, text_buffer, word_array, word_bounds
from counterfact.llm.sampling import remainder
from counterfact.llm.shipping import ship
from counterfact.llm.staging import rows_for, stage_compact

#: Contexts: beginning, after the end of a sentence, after a short, a middling, a long word.
CONTEXTS = 5
SHORT, MIDDLING = 3, 7
#: The end of a text as a word; no other word is empty.
END = b""
#: Pairs of all blocks in a range of digests.
RANGE_PAIRS = 1_500_000
#: Bytes of text of a block; rows that are packed together on their way back to the blocks.
BLOCK_BYTES = 32 << 20
PACK_ROWS = 200_000
#: Words of the vocabulary in a part.
PART_WORDS = 200_000
#: Bytes of payloads that a task hands over at a time.
SENT_BYTES = 4 << 20
#: Pairs that are seated or scored at a time.
LIVE_PAIRS = 1 << 18
#: Words or pairs with few customers whose customers are seated at a time.
SEATED = 1 << 15


@dataclass(frozen=True)
class Sampler:
    """Sweeps that are dropped and kept, and the strength of all restaurants."""

    burn_in: int = 1
    samples: int = 2
    strength: float = 1.0
    single: int = 32
    seed: int = 13


# ---- blocks


def _kinds(words: pa.Array) -> np.ndarray:
    """Context that each distinct word makes for the next token."""
    buf = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(ends)
    last = np.zeros(len(words), np.uint8)
    full = size > 0
    last[full] = buf[ends[1:][full] - 1]
    kind = np.where(size <= SHORT, 2, np.where(size <= MIDDLING, 3, 4))
    return np.where(np.isin(last, list(b".!?")), 1, kind).astype(np.uint8)


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as bytes, the four places apart, so that they compress well."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts as a dictionary array, and the number of words of each text."""
    buf, offsets = text_buffer(texts)
    buf = LOWER[buf]
    starts, ends, firsts = word_bounds(buf, offsets)
    return word_array(buf, starts, ends).dictionary_encode(), np.diff(firsts)


def _block(
    number: int, pieces: list, ids: list[pa.Array], held: list[np.ndarray], schema: pa.Schema
) -> pa.RecordBatch:
    """One row: the texts of a block as numbers, and its distinct words with their counts in training texts,
    all of them and those at the beginning of a text."""
    joined = pa.chunked_array([p for p, _ in pieces]).unify_dictionaries()
    words = joined.chunk(0).dictionary
    numbers = np.concatenate([c.indices.to_numpy() for c in joined.chunks]).astype(np.int64)
    sizes = np.concatenate([s for _, s in pieces])
    words = pa.concat_arrays([words.cast(pa.large_binary()), pa.array([END], pa.large_binary())])
    firsts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=firsts[1:])
    tokens = np.full(int(firsts[-1]), len(words) - 1, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[firsts[1:] - 1] = False
    tokens[inner] = numbers
    # Frequent words get small numbers.
    order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    tokens, words = place[tokens], words.take(pa.array(order))
    out = np.concatenate(held)
    kinds = _kinds(words)
    n = np.bincount(tokens[np.repeat(~out, sizes + 1)], minlength=len(words))
    n0 = np.bincount(tokens[firsts[:-1][~out]], minlength=len(words))
    row = {
        "block": pa.array([number], pa.int64()),
        "ids": pa.ListArray.from_arrays([0, len(sizes)], pa.concat_arrays(ids)),
        "held": pa.array([out.tolist()], pa.list_(pa.bool_())),
        "sizes": pa.array([(sizes + 1).tolist()], pa.list_(pa.int64())),
        "tokens": pa.array([_squeezed(tokens)], pa.binary()),
        "kinds": pa.array([kinds.tobytes()], pa.binary()),
        "words": pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary()).cast(pa.string())),
        "n": pa.ListArray.from_arrays([0, len(words)], pa.array(n)),
        "n0": pa.ListArray.from_arrays([0, len(words)], pa.array(n0)),
    }
    return pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in schema], schema=schema)


def blocks(df: DataFrame, id_col: str, text: str, held: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts in blocks; rows stay in their partition."""
    ship(df.sparkSession)
    inputs = df.select(
        F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(id_col)).alias("id"), held.alias("held")
    )
    out = (
        StructType()
        .add("block", LongType())
        .add("ids", ArrayType(inputs.schema["id"].dataType))
        .add("held", ArrayType(BooleanType()))
        .add("sizes", ArrayType(LongType()))
        .add("tokens", BinaryType())
        .add("kinds", BinaryType())
        .add("words", ArrayType(StringType()))
        .add("n", ArrayType(LongType()))
        .add("n0", ArrayType(LongType()))
    )
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pieces, ids, held_, size = [], [], [], 0
        for batch in batches:
            for part in parts(batch, 0):
                pieces.append(_coded(part.column(0)))
                ids.append(part.column(1))
                held_.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                size += part.column(0).nbytes
                if size >= block_bytes:
                    yield _block(number, pieces, ids, held_, schema)
                    number += 1
                    pieces, ids, held_, size = [], [], [], 0
                    pa.default_memory_pool().release_unused()
        if pieces:
            yield _block(number, pieces, ids, held_, schema)
            pieces, ids, held_ = [], [], []
            pa.default_memory_pool().release_unused()

    return inputs.mapInArrow(run, out)


# ---- words


@dataclass
class Places:
    """Where in the blocks a word is: rows (part, block, size, payload) of numbers in the block and ids, packed by
    parts of the vocabulary, which are cut by the words' digests."""

    packed: DataFrame
    parts: int

    def part(self, digest: Column) -> Column:
        return F.pmod(digest, F.lit(self.parts)).cast("bigint").alias("part")

    def collect(self) -> list:
        """Rows (block, number, id), for small tables."""
        names = ("number", "id")
        return _flat(self.packed, "block", dict(zip(names, ("<i4", "<i8")))).collect()

    def sent(
        self, rows: DataFrame, make: Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]], types: dict[str, str]
    ) -> DataFrame:
        """Rows (block, rows, payload) of what the blocks are told of their words, as ``_packed`` makes them.

        ``rows`` has the columns part and id. ``make`` gets the rows of a part and returns ids, in order, and the
        values of ``types`` but part and id; nothing is sent of the words whose ids it leaves out.
        """

        def run(asked: pa.Table, known: pa.Table) -> pa.Table:
            pa.default_memory_pool().release_unused()
            ids, values = make(known)
            values = [v.astype(t) for v, t in zip(values, [t for c, t in types.items() if c not in ("part", "id")], strict=True)]
            found, sizes, payloads = [], [], []
            for part, block, n, payload in zip(*(asked[c].to_pylist() for c in ("part", "block", "size", "payload"))):
                number, ident = _from_planes(payload, n, "<i4", "<i8")
                at = np.searchsorted(ids, ident)
                if len(ids):
                    some = ids[np.minimum(at, len(ids) - 1)] == ident
                    if not some.all():
                        number, ident, at = number[some], ident[some], at[some]
                if not len(ids) or not len(at):
                    continue
                told = iter(values)
                own = {"part": np.full(len(at), part, "<i4"), "id": ident}
                found.append(block)
                sizes.append(len(at))
                payloads.append(_planes(number, *[own[c] if c in own else next(told)[at] for c in types]))
            columns = [pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())]
            return pa.Table.from_arrays(columns, ["block", "rows", "payload"])

        told = self.packed.groupBy("part").cogroup(rows.groupBy("part"))
        return told.applyInArrow(run, "block bigint, rows bigint, payload binary")


def word_places(staged: DataFrame, vocabulary: DataFrame, words: int) -> Places:
    """Places of the words of all blocks that the vocabulary (id, word) holds."""
    places = Places(staged, rows_for(words, PART_WORDS))
    parts = places.parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            names = row.column(1).flatten().cast(pa.large_binary())
            part = row.column(2).flatten().to_numpy() % parts
            order = np.argsort(part, kind="stable")
            names = names.take(pa.array(order))
            ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
            data = names.buffers()[2]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            rows = []
            for x, y in zip(edges[some].tolist(), edges[some + 1].tolist()):
                size = int(ends[y] - ends[x])
                packed = pa.Codec("zstd").compress(data[int(ends[x]) : int(ends[y])], asbytes=True) if size else b""
                rows.append((y - x, size, _planes(order[x:y].astype("<i4"), np.diff(ends[x : y + 1]).astype("<i4")), packed))
            sizes, bytes_, payloads, packed = zip(*rows)
            columns = [
                pa.array(some, pa.int64()), pa.array([row.column(0)[0].as_py()] * len(some), pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(bytes_, pa.int64()), pa.array(payloads, pa.binary()),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "size", "bytes", "payload", "words"])

    def find(asked: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        numbers, names = [], []
        sizes = asked["size"].to_pylist()
        for n, size, payload, words in zip(sizes, *(asked[c].to_pylist() for c in ("bytes", "payload", "words"))):
            number, lengths = _from_planes(payload, n, "<i4", "<i4")
            data = pa.Codec("zstd").decompress(words, size) if size else pa.py_buffer(b"")
            ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
            names.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), data]))
            numbers.append(number)
        ids = known["id"].to_numpy()
        of_part = known["word"].cast(pa.string()).cast(pa.binary()).cast(pa.large_binary())
        at = pa.compute.index_in(pa.chunked_array(names, pa.large_binary()), value_set=of_part.combine_chunks())
        at = pa.compute.fill_null(at, -1).to_numpy()
        firsts = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int64)
        payloads, held = [], []
        for k, number in enumerate(numbers):
            here = at[firsts[k] : firsts[k + 1]]
            some = np.flatnonzero(here >= 0)
            held.append(len(some))
            payloads.append(_planes(number[some], ids[here[some]].astype("<i8")) if len(some) else b"")
        columns = [asked["part"], asked["block"], pa.array(held, pa.int64()), pa.array(payloads, pa.binary())]
        return pa.Table.from_arrays(columns, ["part", "block", "size", "payload"])

    asked = _texts(staged).select("block", "words", "digests").mapInArrow(
        cut, "part bigint, block bigint, size bigint, bytes bigint, payload binary, words binary"
    )
    known = vocabulary.select(places.part(F.xxhash64("word")), "id", "word")
    found = asked.groupBy("part").cogroup(known.groupBy("part"))
    found = found.applyInArrow(find, "part bigint, block bigint, size bigint, payload binary")
    return replace(places, packed=stage_compact(found, "places"))


def _flat(packed: DataFrame, key: str, types: dict[str, str]) -> DataFrame:
    """Rows of the key and the values of payloads."""
    out = StructType().add(key, LongType())
    for c in types:
        out = out.add(c, LongType())
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                values = [pa.array(v.astype(np.int64)) for v in _from_planes(payload, n, *types.values())]
                yield pa.RecordBatch.from_arrays([pa.array([of] * n, pa.int64()), *values], schema=schema)

    return packed.select(key, "size", "payload").mapInArrow(run, out)


def _by_part(known: dict[str, np.ndarray], sums: list[np.ndarray]) -> tuple[list[int], list[int], list[bytes]]:
    """Parts, sizes and payloads (id, sums) of the words of a block that have a sum."""
    some = np.flatnonzero(np.any(sums, axis=0))
    some = some[np.argsort(known["part"][some], kind="stable")]
    if not len(some):
        return [], [], []
    part = known["part"][some]
    firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(firsts[1:], len(part))
    spans = [some[x:y] for x, y in zip(firsts.tolist(), ends.tolist())]
    payloads = [_planes(known["id"][at].astype("<i8"), *[v[at].astype("<i8") for v in sums]) for at in spans]
    return part[firsts].tolist(), (ends - firsts).tolist(), payloads


def _added(
    rows: DataFrame, messages: DataFrame, columns: list[str], out: StructType, then: Callable[[pa.Table], pa.Table]
) -> DataFrame:
    """``then`` of the rows (part, id, ...) of a part, after what the messages (part, size, payload) of the blocks add
    to the columns."""

    def run(known: pa.Table, told: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        ids = known["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        sums = [known[c].to_numpy().copy() for c in columns]
        for n, payload in zip(told["size"].to_pylist(), told["payload"].to_pylist()):
            ident, *values = _from_planes(payload, n, *["<i8"] * (len(columns) + 1))
            at = order[np.searchsorted(ids, ident)]
            for total, v in zip(sums, values):
                total[at] += v
        for c, total in zip(columns, sums):
            known = known.set_column(known.schema.get_field_index(c), c, pa.array(total))
        return then(known)

    messages = messages.select("part", "size", "payload")
    return rows.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(run, out)


# ---- pairs


def _mixed(u: np.ndarray, w: np.ndarray, salt: int) -> np.ndarray:
    """Digests of 64 bits of pairs of digests."""
    with np.errstate(over="ignore"):
        x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        x ^= x >> np.uint64(32)
        x = (x * np.uint64(0xBF58476D1CE4E5B9)) ^ w.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _planes(*columns: np.ndarray) -> bytes:
    """Columns as bytes, the places of their numbers apart, so that they compress well; high places that are zero in
    all numbers of a column are left out. The first bytes are the places of each column."""
    widths, data = [], []
    for c in columns:
        width = c.itemsize
        if c.dtype.kind in "iu" and len(c) and c.min() >= 0:
            width = max(1, (int(c.max()).bit_length() + 7) // 8)
        places = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
        data.append(np.ascontiguousarray(places[:, :width].T).tobytes())
        widths.append(width)
    return bytes(widths) + pa.Codec("zstd").compress(b"".join(data), asbytes=True)


def _from_planes(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, t) for t in types]
    widths = list(data[: len(types)])
    raw = pa.Codec("zstd").decompress(memoryview(data)[len(types) :], n * sum(widths), asbytes=True)
    raw = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    for t, width in zip(types, widths):
        places = raw[at : at + n * width].reshape(width, n)
        at += n * width
        if width == 1:
            out.append(places[0].astype(t))
            continue
        full = np.zeros((n, np.dtype(t).itemsize), np.uint8)
        full[:, :width] = places.T
        out.append(full.view(t).reshape(-1))
    return out


@dataclass
class Block:
    """A block's tokens and its distinct pairs, in the order of their words' numbers; ``place`` is the pair of a token.

    ``place`` is -1 for first tokens. ``n`` are the pairs' counts in the training texts of the block. Only one of them
    is found, the other is empty.
    """

    tokens: np.ndarray
    sizes: np.ndarray
    firsts: np.ndarray
    kinds: np.ndarray
    before: np.ndarray
    after: np.ndarray
    n: np.ndarray
    place: np.ndarray


#: Columns of a block that hold its tokens and pairs.
_BLOCK = ["held", "sizes", "tokens", "kinds"]


def _block_of(row: pa.RecordBatch, places: bool = False) -> Block:
    """The block of one row with the columns above; with the pairs of its tokens if asked for, else with their counts."""
    pa.default_memory_pool().release_unused()
    held, sizes, tokens, kinds = (row.column(row.schema.get_field_index(c)) for c in _BLOCK)
    sizes = sizes.flatten().to_numpy()
    kinds = np.frombuffer(kinds[0].as_py(), np.uint8)
    words = len(kinds)
    firsts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=firsts[1:])
    tokens = _unsqueezed(tokens[0].as_py(), int(firsts[-1])).astype(np.int32)
    inner = np.ones(len(tokens), bool)
    inner[firsts[:-1]] = False
    # Numbers of the pairs that end at a token which has one before it.
    codes = tokens[:-1].astype(np.int64)
    codes *= words
    codes += tokens[1:]
    new = np.ones(int(inner.sum()), bool)
    if places:
        codes = codes[inner[1:]]
        codes, order = _ordered(codes, np.flatnonzero(inner).astype(np.int32), words * words)
        np.not_equal(codes[1:], codes[:-1], out=new[1:])
        place = np.full(len(tokens), -1, np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        codes, n = codes[new], np.zeros(0, np.int32)
        del order
    else:
        # Sorted in place, with the texts that are not learned from in the last bit.
        codes *= 2
        codes += np.repeat(held.flatten().to_numpy(zero_copy_only=False).astype(bool), sizes)[1:]
        codes = codes[inner[1:]]
        codes.sort()
        out = (codes & 1).astype(np.uint8)
        codes >>= 1
        np.not_equal(codes[1:], codes[:-1], out=new[1:])
        at = np.flatnonzero(new)
        codes = codes[at]
        n = np.diff(at, append=len(out)).astype(np.int32)
        if len(at):
            n -= np.add.reduceat(out, at, dtype=np.int32)
        place = np.zeros(0, np.int32)
        del out, at
    before = codes // words
    codes -= before * words
    return Block(tokens, sizes, firsts, kinds, before.astype(np.int32), codes.astype(np.int32), n, place)


def _ordered(codes: np.ndarray, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes below the end, in order, and the ascending places they come from; sorted as one number with these, in
    place, if it has the bits."""
    bits = int(places.max(initial=0)).bit_length()
    if end << bits >= 1 << 63:
        order = np.argsort(codes, kind="stable")
        return codes[order], places[order]
    codes <<= bits
    codes += places
    codes.sort()
    np.bitwise_and(codes, (1 << bits) - 1, out=places, casting="unsafe")
    codes >>= bits
    return codes, places


def _digest(row: pa.RecordBatch, block: Block, salt: int) -> np.ndarray:
    """Digests of the block's pairs."""
    words = row.column(row.schema.get_field_index("digests")).flatten().to_numpy()
    return _mixed(words[block.before], words[block.after], salt)


def _texts(staged: DataFrame) -> DataFrame:
    return staged.withColumn("digests", F.transform("words", lambda w: F.xxhash64(w)))


def pair_counts(staged: DataFrame, ranges: int) -> DataFrame:
    """Rows (block, range, size, payload, once, twice) of what the pairs of every block count in all blocks.

    A payload holds, in the order of the digests of the block's pairs, their counts in all training texts and whether this
    block is the one of those that adds the pair to sums. ``once`` and ``twice`` count the pairs it adds that
    occur so often.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = _block_of(row)
                digest = _digest(row, block, 1)
                order = np.argsort(digest)
                digest, n = digest[order], block.n[order]
                more = (_digest(row, block, 2) >> np.uint64(32)).astype("<u4")[order]
                part = ((digest >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
                edges = np.searchsorted(part, np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(edges))
                payloads, size, sent = [], 0, 0
                for x, y in zip(edges[some], edges[some + 1]):
                    steps = np.diff(digest[x:y], prepend=digest[x])
                    steps[0] = 0
                    payloads.append(digest[x : x + 1].tobytes() + _planes(steps, more[x:y], n[x:y]))
                    size += len(payloads[-1])
                    if size >= SENT_BYTES or y == len(digest):
                        ranges_ = some[sent : sent + len(payloads)]
                        columns = [
                            pa.array(ranges_, pa.int64()),
                            pa.array([row.column(0)[0].as_py()] * len(ranges_), pa.int64()),
                            pa.array(np.diff(edges)[ranges_], pa.int64()),
                            pa.array(payloads, pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["range", "block", "size", "payload"])
                        sent += len(payloads)
                        payloads, size = [], 0

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sizes = table["size"].to_numpy()
        digest, more, n = [], [], []
        for size, payload in zip(sizes.tolist(), table["payload"].to_pylist()):
            first, payload = np.frombuffer(payload[:8], np.uint64), memoryview(payload)[8:]
            steps, m, counts = _from_planes(payload, size, "<u8", "<u4", "<i8")
            digest.append(np.cumsum(steps, dtype=np.uint64) + first)
            more.append(m)
            n.append(counts)
        digest, more, n = np.concatenate(digest), np.concatenate(more), np.concatenate(n)
        order = np.argsort(digest)
        if ((digest[order[1:]] == digest[order[:-1]]) & (more[order[1:]] != more[order[:-1]])).any():
            order = np.lexsort((more, digest))
        digest, more = digest[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (more[1:] != more[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        total = np.empty(len(order), np.int64)
        total[order] = np.add.reduceat(n[order], first)[group]
        # The first of a pair's blocks adds it to sums.
        adds = np.zeros(len(order), np.uint8)
        adds[np.minimum.reduceat(order, first)] = 1
        edges = np.append(0, np.cumsum(sizes))
        spans = list(zip(edges[:-1], edges[1:]))
        count = lambda k: [int(((total[x:y] == k) & (adds[x:y] == 1)).sum()) for x, y in spans]
        columns = {
            "block": table["block"],
            "range": table["range"],
            "size": table["size"],
            "payload": pa.array([_planes(total[x:y].astype("<i8"), adds[x:y]) for x, y in spans], pa.binary()),
            "once": pa.array(count(1), pa.int64()),
            "twice": pa.array(count(2), pa.int64()),
        }
        return pa.table(columns)

    rows = _texts(staged).select("block", *_BLOCK, "digests").mapInArrow(
        cut, "range bigint, block bigint, size bigint, payload binary"
    )
    merged = "block bigint, range bigint, size bigint, payload binary, once bigint, twice bigint"
    return rows.groupBy("range").applyInArrow(merge, merged)


def _joined(table: pa.Table, *types: str) -> list[np.ndarray]:
    """The columns of a block's payloads of the given types, ranges in order."""
    table = table.sort_by("range")
    found = [_from_planes(p, n, *types) for n, p in zip(table["size"].to_pylist(), table["payload"].to_pylist())]
    return [np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in enumerate(types)]


def _sums(block: Block, tables: np.ndarray) -> list[np.ndarray]:
    """For every word of a block: tables of its own restaurant, customers in each class that pairs bring."""
    words = len(block.kinds)
    own = np.bincount(block.before, tables, words).astype(np.int64)
    cells = block.after.astype(np.int64) * CONTEXTS + block.kinds[block.before]
    customers = np.bincount(cells, tables, words * CONTEXTS).astype(np.int64).reshape(-1, CONTEXTS)
    return [own, *customers.T[1:]]


_SUMS = ["n", "own", *[f"n{k}" for k in range(CONTEXTS)]]
#: What the pairs add to the sums of a word.
_ADDED = ["own", *[f"n{k}" for k in range(1, CONTEXTS)]]


def word_counts(staged: DataFrame) -> DataFrame:
    """Rows (word, n, n0) of the training texts: occurrences, and those at the beginning of a text."""
    rows = staged.select(F.inline(F.arrays_zip("words", "n", "n0"))).where("n > 0")
    return rows.groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"))


def _seated_pairs(staged: DataFrame, pairs: DataFrame, packed: DataFrame, discount: float, rule: Sampler) -> DataFrame:
    """Rows (word, n, own, n0, ...) of the tables the pairs sit at at first; a row for each word of a block."""
    sat = _first_seats(staged, pairs, packed, discount, rule, _FIRST).where("part is not null")
    added = _flat(sat, "part", dict.fromkeys(["id", *_ADDED], "<i8"))
    words = staged.select(F.col("block").alias("part"), F.posexplode(F.arrays_zip("words", "n", "n0")).alias("id", "w"))
    words = words.join(added, ["part", "id"], "left").select("w.words", "w.n", "w.n0", *_ADDED)
    return words.where("n > 0 or own is not null or n1 is not null").withColumnRenamed("words", "word").na.fill(0, _ADDED)


def _first_seats(
    staged: DataFrame, pairs: DataFrame, packed: DataFrame, discount: float, rule: Sampler, types: dict[str, str]
) -> DataFrame:
    """Rows (part, size, payload) of the tables the pairs of a block sit at at first; and a row for each block.

    A block's ``payload`` holds the training counts of its pairs. ``live`` are the pairs that can sit at more tables
    than one, in the order of their words' numbers, and ``seats`` the tables they sit at. ``types`` are what ``packed``
    tells of the words; without ids and parts, these are the numbers in the block and the block.
    """
    out = StructType()
    for c in ("part", "block", "size", "n_live"):
        out = out.add(c, LongType())
    for c in ("payload", "live", "seats"):
        out = out.add(c, BinaryType())
    schema = to_arrow_schema(out)

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        counted, words = _parted(given)
        for row in (b.slice(k, 1) for b in block.to_batches() for k in range(b.num_rows)):
            one = _block_of(row)
            digest = _digest(row, one, 1)
            order = np.argsort(digest)
            n, adds = np.empty(len(order), np.int64), np.empty(len(order), np.uint8)
            n[order], adds[order] = _joined(counted, "<i8", "u1")
            known = _unpacked(words, len(one.kinds), types)
            tables = (n > 0).astype(np.int64)
            more = np.flatnonzero(n > 1)
            digest = digest[more]
            before, after = one.before[more], one.after[more]
            kind = one.kinds[before]
            if "share" in known:
                others, base = np.zeros(len(more)), known["share"][after]
            else:
                others, base = known["own"][before] - 1.0, _by_class(known, _CHANCES)[after, kind]
            tables[more] = seated(
                n[more], others, base.astype(np.float64), discount, rule.strength, digest, rule.seed - 1, rule.single
            ).astype(np.int64)
            known.setdefault("id", np.arange(len(one.kinds)))
            known.setdefault("part", np.full(len(one.kinds), row.column(0)[0].as_py()))
            part, sizes, payloads = _by_part(known, _sums(one, tables * adds))
            told = {
                "part": pa.array(part, pa.int64()),
                "size": pa.array(sizes, pa.int64()),
                "payload": pa.array(payloads, pa.binary()),
            }
            found.append(_filled(told, len(part), schema))
            payload = {
                "block": row.column(0),
                "size": pa.array([len(tables)], pa.int64()),
                "payload": pa.array([_planes(n.astype("<i8"))], pa.binary()),
                "n_live": pa.array([len(more)], pa.int64()),
                "live": pa.array([_live_payload(before, after, kind, adds[more], n[more])], pa.binary()),
                "seats": pa.array([_planes(tables[more])], pa.binary()),
            }
            found.append(_filled(payload, 1, schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    texts = _texts(staged).select("block", *_BLOCK, "digests")
    given = _given(pairs, packed)
    return texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, out)


def _filled(columns: dict, n: int, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in schema}, schema=schema)


def _live_payload(before: np.ndarray, after: np.ndarray, kind: np.ndarray, adds: np.ndarray, n: np.ndarray) -> bytes:
    """Live pairs: numbers of the words, class of the word before, whether the block adds them to sums, counts."""
    return _planes(np.diff(before, prepend=0).astype("<i4"), after.astype("<i4"), kind, adds, n.astype("<i8"))


def _live_pairs(data: bytes, n: int) -> list[np.ndarray]:
    steps, *rest = _from_planes(data, n, "<i4", "<i4", "u1", "u1", "<i8")
    return [np.cumsum(steps, dtype=np.int64), *rest]


def _resampled_pairs(
    fixed: DataFrame, seats: DataFrame, packed: DataFrame, totals: Totals, discount: float, turn: int, rule: Sampler
) -> DataFrame:
    """One sweep over the live pairs: rows (part, size, payload) of what changes for the words of a part; and
    (block, size, payload, n1, ...) of the tables that each block's pairs sit at, and of all that changes by it.

    ``fixed`` has the live pairs of the blocks, ``seats`` the tables they sat at and ``packed`` the seating of their
    words.
    """
    out = StructType()
    for c in ("part", "block", "size", *_COUNTS[1:]):
        out = out.add(c, LongType())
    out = out.add("payload", BinaryType())
    schema = to_arrow_schema(out)

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        sat, words = _parted(given)
        for number, size, live in zip(*(block[c].to_pylist() for c in ("block", "n_live", "live"))):
            pa.default_memory_pool().release_unused()
            before, after, kind, adds, n = _live_pairs(live, size)
            tables = _joined(sat, "<i8")[0]
            top = int(max(before.max(initial=-1), after.max(initial=-1))) + 1
            known = _unpacked(words, top, _SEATING)
            counts, class_tables = _by_class(known, _COUNTS), _by_class(known, _TABLES)
            in_all = class_tables.sum(1)
            new = np.empty(size, np.int64)
            for x in range(0, size, LIVE_PAIRS):
                some = slice(x, x + LIVE_PAIRS)
                u, w, c = before[some], after[some], kind[some]
                keys = _mixed(known["id"][u], known["id"][w], 3)
                new[some] = pair_sweep(
                    n[some], tables[some], known["own"][u], c, counts[w, c], class_tables[w, c], in_all[w],
                    known["above"][w], keys, totals, discount, turn, rule,
                )
            moved = (new - tables) * adds
            own = np.bincount(before, moved, top).astype(np.int64)
            cells = np.bincount(after.astype(np.int64) * CONTEXTS + kind, moved, top * CONTEXTS)
            sums = [own, *cells.astype(np.int64).reshape(-1, CONTEXTS).T[1:]]
            part, sizes, payloads = _by_part(known, sums)
            told = {
                "part": pa.array(part, pa.int64()),
                "size": pa.array(sizes, pa.int64()),
                "payload": pa.array(payloads, pa.binary()),
            }
            found.append(_filled(told, len(part), schema))
            payload = {
                "block": pa.array([number], pa.int64()),
                "size": pa.array([size], pa.int64()),
                "payload": pa.array([_planes(new.astype("<i8"))], pa.binary()),
            } | {c: pa.array([int(v.sum())], pa.int64()) for c, v in zip(_COUNTS[1:], sums[1:])}
            found.append(_filled(payload, 1, schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    # The first seats are of the same table; a new name tells the columns apart.
    live = fixed.select(F.col("block").alias("block"), "n_live", "live")
    return live.groupBy("block").cogroup(_given(seats, packed).groupBy("block")).applyInArrow(run, out)


def _given(pairs: DataFrame, *packed: DataFrame) -> DataFrame:
    """Payloads of pairs and of words as one table; those of words have the ranges -1, -2, ..."""
    given = pairs.select("block", "range", "size", "payload")
    for k, words in enumerate(packed, 1):
        given = given.unionByName(
            words.select("block", F.lit(-k).cast("bigint").alias("range"), F.col("rows").alias("size"), "payload")
        )
    return given


def _parted(given: pa.Table) -> tuple[pa.Table, pa.Table]:
    of_words = pa.compute.less(given["range"], 0)
    return given.filter(pa.compute.invert(of_words)), given.filter(of_words)


# ---- sampling


def _stirred(x: np.ndarray, salt: int) -> np.ndarray:
    """Digests of numbers of 64 bits and a salt."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from digests."""
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _poisson(mean: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Poisson numbers: by the distribution function for small means, else the nearest to a normal number."""
    u = _uniform(_stirred(x, 1))
    out = np.zeros(len(mean))
    few = np.flatnonzero(mean < 30)
    below = np.exp(-mean[few])
    more = u[few] > below
    few, below = few[more], below[more]
    term = below.copy()
    k = 0
    while len(few):
        k += 1
        out[few] = k
        term = term * mean[few] / k
        below = below + term
        more = (u[few] > below) & (k < 200)
        few, term, below = few[more], term[more], below[more]
    many = np.flatnonzero(mean >= 30)
    if len(many):
        normal = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * math.pi * _uniform(_stirred(x[many], 2)))
        out[many] = np.maximum(0, np.rint(mean[many] + np.sqrt(mean[many]) * normal))
    return out


def seated(
    customers: np.ndarray,
    others: np.ndarray,
    base: np.ndarray,
    discount: float,
    strength: float,
    keys: np.ndarray,
    salt: int,
    single: int,
) -> np.ndarray:
    """Tables that the customers of each word sit at, given the tables of all other words.

    ``others`` is the number of the other words' tables and ``base`` the word's probability in the parent.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    # Few at a time stay in the processor's cache; those with many customers take many steps, and go together.
    many = customers[live] > single
    few = live[~many]
    for some in (live[many], *[few[x : x + SEATED] for x in range(0, len(few), SEATED)]):
        _seat(tables, some, customers, others, base, discount, strength, keys, salt, single)
    return tables


def _seat(
    tables: np.ndarray,
    live: np.ndarray,
    customers: np.ndarray,
    others: np.ndarray,
    base: np.ndarray,
    discount: float,
    strength: float,
    keys: np.ndarray,
    salt: int,
    single: int,
) -> None:
    # Those with the most customers come first, so the ones of whom some still stand are a slice.
    sizes = customers[live]
    order = np.argsort(sizes)
    live, sizes = live[order[::-1]], sizes[order]
    customers, others, base = sizes[::-1], others[live], base[live]
    x = _stirred(keys[live].astype(np.uint64), salt)
    sit = np.ones(len(live))
    sat = 1
    step = 0
    left = len(live)
    while left:
        group = max(1, sat // single)
        own = sit[:left]
        new = (strength + discount * (others[:left] + own)) * base[:left]
        q = new / (new + sat + (group - 1) / 2 - discount * own)
        drawn = _stirred(x[:left], step)
        if group == 1:
            own += _uniform(drawn) < q
        else:
            size = np.minimum(group, customers[:left] - sat)
            own += np.minimum(_poisson(size * q, drawn), size)
        sat += group
        step += 1
        left = len(live) - int(np.searchsorted(sizes, sat, side="right"))
    tables[live] = sit


@dataclass
class Totals:
    """Totals of a seating: customers and tables of each context, tables of the parent; and the parameters."""

    customers: np.ndarray
    tables: np.ndarray
    parent_tables: float
    vocabulary: int
    discount: float
    parent_discount: float
    strength: float

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the parent, given their customers and tables there."""
        free = (self.strength + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)
        top = np.maximum(customers - self.parent_discount * tables, 0) + free
        return top / (self.strength + self.tables.sum())

    def unknown(self) -> np.ndarray:
        """Probability of the unknown word in each context."""
        return self.back() * self.parent(np.zeros(1), np.zeros(1))

    def back(self) -> np.ndarray:
        """Share of each context that goes to the parent."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers)

    def predictive(self, counts: np.ndarray, tables: np.ndarray, parent_tables: np.ndarray) -> np.ndarray:
        """Probability of words (rows) in each context (columns)."""
        own = np.maximum(counts - self.discount * tables, 0) / (self.strength + self.customers)
        return own + self.back() * self.parent(tables.sum(1), parent_tables)[:, None]


def sweep(
    counts: np.ndarray,
    tables: np.ndarray,
    parent_tables: np.ndarray,
    keys: np.ndarray,
    totals: Totals,
    turn: int,
    rule: Sampler,
) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over words: new tables in each context and in the parent."""
    tables = tables.copy()
    above = parent_tables.copy()
    for c in range(CONTEXTS):
        here = np.flatnonzero(counts[:, c] > 0)
        if not len(here):
            continue
        left = tables[here].sum(1) - tables[here, c]
        # The parent's customers that stay keep as many of its tables as they can sit at.
        stay = np.where(left > 0, np.clip(above[here], 1, np.maximum(left, 1)), 0)
        base = totals.parent(left, stay)
        tables[here, c] = seated(
            counts[here, c], totals.tables[c] - tables[here, c], base, totals.discount, totals.strength,
            keys[here], rule.seed + 101 * turn + c, rule.single,
        )
    even = np.full(len(keys), 1.0 / (totals.vocabulary + 1))
    above = seated(
        tables.sum(1).astype(np.int64), totals.parent_tables - parent_tables, even, totals.parent_discount,
        totals.strength, keys, rule.seed + 101 * turn + CONTEXTS, rule.single,
    )
    return tables, above


def pair_sweep(
    customers: np.ndarray,
    tables: np.ndarray,
    own: np.ndarray,
    kinds: np.ndarray,
    counts: np.ndarray,
    class_tables: np.ndarray,
    in_all: np.ndarray,
    above: np.ndarray,
    keys: np.ndarray,
    totals: Totals,
    discount: float,
    turn: int,
    rule: Sampler,
) -> np.ndarray:
    """One Gibbs sweep over pairs: new tables in the restaurants of the words before.

    ``own`` are all tables there, and ``kinds`` the class whose customers the pair's tables are. ``counts`` and
    ``class_tables`` are the customers and tables in this class of the word that follows, ``in_all`` its tables in all
    classes and ``above`` those in the parent.
    """
    # Without the pair's tables, the class and the parent keep as many tables as the customers that stay can sit at.
    left = counts - tables
    stay = np.where(left > 0, np.clip(class_tables, 1, np.maximum(left, 1)), 0)
    up = in_all - class_tables + stay
    up_stay = np.where(up > 0, np.clip(above, 1, np.maximum(up, 1)), 0)
    base = np.maximum(left - totals.discount * stay, 0) / (totals.strength + totals.customers[kinds])
    base += totals.back()[kinds] * totals.parent(up, up_stay)
    salt = rule.seed + 101 * turn + CONTEXTS + 1
    return seated(customers, own - tables, base, discount, rule.strength, keys, salt, rule.single).astype(np.int64)


_COUNTS = [f"n{k}" for k in range(CONTEXTS)]
_TABLES = [f"t{k}" for k in range(CONTEXTS)]
_CHANCES = [f"p{k}" for k in range(CONTEXTS)]
#: What is sent of a word to the blocks before anything is seated, and in a sweep of the pairs.
_FIRST = {"n": "<i8", "own": "<i8"} | dict.fromkeys(_CHANCES, "<f4")
_SEATING = {"part": "<i4"} | dict.fromkeys(["id", "own", *_COUNTS, *_TABLES, "above"], "<i8")


def _by_class(known: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return np.stack([known[c] for c in names], axis=1)


def _totals(seating: DataFrame, vocabulary: int, discounts: tuple[float, float], rule: Sampler) -> Totals:
    sums = seating.agg(*[F.sum(c).alias(c) for c in (*_COUNTS, *_TABLES, "above")]).first()
    value = lambda c: float(sums[c] or 0)
    return Totals(
        np.array([value(c) for c in _COUNTS]), np.array([value(c) for c in _TABLES]), value("above"), vocabulary,
        *discounts, rule.strength,
    )


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass
class Seating:
    """A sampled seating: words with customers and tables, their totals, and the tables of the blocks' pairs."""

    words: DataFrame
    totals: Totals
    pairs: DataFrame


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of the batches, some hundred thousand at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PACK_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["id"].to_numpy())))


def _values(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in names], axis=1)


def _told(names: list[str], least: int = 1) -> Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]]:
    """For ``Places.sent``: the columns of the words that occur so often at least."""

    def make(known: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        known = _sorted(known.filter(pa.compute.greater_equal(known["n"], least)))
        return known["id"].to_numpy(), [known[c].to_numpy() for c in names]

    return make


def sample_seatings(
    sums: DataFrame, fixed: DataFrame, places: Places, pair_discount: float, rule: Sampler
) -> list[Seating]:
    """The sampled seatings of all restaurants.

    ``sums`` is a written table (id, word, n, own, n0, n1, ...) of the first seating of the pairs, ``fixed`` the rows
    of its blocks and ``places`` says where in the blocks a word is.
    """
    many = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in _COUNTS for k in (1, 2)]
    contexts = sum((F.col(c) > 0).cast("int") for c in _COUNTS)
    facts = sums.agg(
        F.count("*").alias("words"),
        F.count_if(contexts == 1).alias("one"),
        F.count_if(contexts == 2).alias("two"),
        *many,
    ).first()
    discount = _discount(*[sum(facts[f"{c}_{k}"] for c in _COUNTS) for k in (1, 2)])
    discounts = (discount, _discount(facts["one"], facts["two"]))
    # At first every word has one table where it has customers.
    state = sums.select(
        "id",
        F.xxhash64("word").alias("key"),
        "n",
        "own",
        *_COUNTS,
        *[(F.col(n) > 0).cast("bigint").alias(t) for n, t in zip(_COUNTS, _TABLES)],
        F.lit(1).cast("bigint").alias("above"),
    )
    schema = to_arrow_schema(state.schema)
    totals = _totals(state, facts["words"], discounts, rule)
    seats = fixed.select("block", F.lit(0).cast("bigint").alias("range"), F.col("n_live").alias("size"), F.col("seats").alias("payload"))

    def seated_anew(table: pa.Table, turn: int, before: Totals) -> list[pa.Array]:
        n, t = _values(table, _COUNTS), _values(table, _TABLES).astype(np.float64)
        above, keys = table["above"].to_numpy().astype(np.float64), table["key"].to_numpy()
        t, above = sweep(n, t, above, keys, before, turn, rule)
        new = {c: pa.array(t[:, k].astype(np.int64)) for k, c in enumerate(_TABLES)}
        new["above"] = pa.array(above.astype(np.int64))
        return [new[f.name] if f.name in new else table[f.name].combine_chunks() for f in schema]

    def first_turn(batches: Iterator[pa.RecordBatch], before: Totals = totals) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            yield pa.RecordBatch.from_arrays(seated_anew(table, 0, before), schema=schema)

    def next_turn(turn: int, before: Totals) -> Callable[[pa.Table], pa.Table]:
        return lambda table: pa.Table.from_arrays(seated_anew(table, turn, before), schema=schema)

    kept = []
    for turn in range(rule.burn_in + rule.samples):
        if not turn:
            now = state.mapInArrow(first_turn, state.schema)
        else:
            rows = state.select(places.part(F.col("key")), *schema.names)
            # Both words of a pair that occurs twice do so.
            packed = places.sent(rows, _told(list(_SEATING)[2:], 2), _SEATING)
            moved = stage_compact(
                _resampled_pairs(fixed, seats, packed, totals, pair_discount, turn, rule), f"tables-{turn}"
            )
            seats = moved.where("block is not null").select("block", F.lit(0).cast("bigint").alias("range"), "size", "payload")
            more = moved.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _COUNTS[1:]]).first()
            totals = replace(totals, customers=totals.customers + np.array([0, *more], float))
            told = moved.where("part is not null")
            now = _added(rows, told, _ADDED, state.schema, next_turn(turn, totals))
        state = stage_compact(now, f"seating-{turn}")
        totals = _totals(state, facts["words"], discounts, rule)
        if turn >= rule.burn_in:
            kept.append(Seating(state, totals, seats))
    return kept


# ---- scoring


def _packed(rows: DataFrame, types: dict[str, str] = _FIRST) -> DataFrame:
    """Rows of (block, number, ...) as a few rows for a block, their values squeezed together."""

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        firsts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        values = [table[c].to_numpy().astype(t)[order] for c, t in (("number", "<i4"), *types.items())]
        sizes = np.diff(np.append(firsts, len(block)))
        payloads = [_planes(*[v[x : x + n] for v in values]) for x, n in zip(firsts.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[firsts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())],
            ["block", "rows", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            yield from pack(table)

    return rows.mapInArrow(run, "block bigint, rows bigint, payload binary")


def _unpacked(packed: pa.Table, words: int, types: dict[str, str]) -> dict[str, np.ndarray]:
    """What was sent of the first words of a block; zero of words that nothing was sent of."""
    out = {c: np.zeros(words, t) for c, t in types.items()}
    for n, payload in zip(packed["size"].to_pylist(), packed["payload"].to_pylist()):
        number, *values = _from_planes(payload, n, "<i4", *types.values())
        asked = None if number.max(initial=-1) < words else number < words
        for c, v in zip(types, values):
            if asked is None:
                out[c][number] = v
            else:
                out[c][number[asked]] = v[asked]
    return out


def score_texts(
    df: DataFrame,
    held: Column,
    id_col: str = "doc_id",
    text: str = "text",
    rule: Sampler = Sampler(),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    The model learns from the rows for which ``held`` is false. ``base_score`` is the score of the words' counts
    with one added; both are logarithms to base ten.
    """
    staged = stage_compact(blocks(df, id_col, text, held, block_bytes), "blocks")
    size = staged.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0
    pairs = stage_compact(pair_counts(staged, rows_for(size, RANGE_PAIRS, 1)), "pairs")
    discount = _discount(*[int(n or 0) for n in pairs.agg(F.sum("once"), F.sum("twice")).first()])
    vocabulary = stage_compact(word_counts(staged).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    facts = vocabulary.agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
    tokens, words_known = facts["tokens"] or 0, facts["words"]
    places = word_places(staged, vocabulary, words_known)
    # Before anything is seated: the words as they occur, and a restaurant with no table but the pair's own.
    named = vocabulary.select(places.part(F.xxhash64("word")), "id", "n")

    def shares(known: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        known = _sorted(known)
        n = known["n"].to_numpy()
        return known["id"].to_numpy(), [(n + 1) / (tokens + words_known + 1)]

    first = {"part": "<i4", "id": "<i8", "share": "<f4"}
    sat = _first_seats(staged, pairs, places.sent(named, shares, first), discount, rule, first)
    sat = stage_compact(sat, "tables")
    empty = vocabulary.select(
        places.part(F.xxhash64("word")), "id", "word", "n", "n0", *[F.lit(0).cast("bigint").alias(c) for c in _ADDED]
    )
    names = ["id", "word", *_SUMS]
    sums = _added(
        empty, sat.where("part is not null"), _ADDED, empty.select(*names).schema, lambda table: table.select(names)
    )
    sums = stage_compact(sums, "sums")
    fixed = sat.where("block is not null")
    kept = sample_seatings(sums, fixed, places, discount, rule)
    types = dict.fromkeys(["n", "own", *_COUNTS, *_TABLES, "above"], "<i8")
    told = [
        places.sent(one.words.select(places.part(F.col("key")), "id", *types), _told(list(types)), types) for one in kept
    ]
    counted = fixed.select("block", F.lit(0).cast("bigint").alias("range"), "size", "payload")
    for k, one in enumerate(kept, 1):
        counted = counted.unionByName(one.pairs.withColumn("range", F.lit(k).cast("bigint")))
    given = _given(counted, *told)
    totals = [one.totals for one in kept]
    samples = len(kept)
    texts = staged.select("block", "ids", *_BLOCK)
    id_type = df.schema[id_col].dataType
    out = StructType().add("id", id_type).add("held_out", BooleanType())
    out = out.add("n_tokens", LongType()).add("n_known", LongType())
    out = out.add("base_score", DoubleType()).add("score", DoubleType())
    schema = to_arrow_schema(out)

    def score(block: pa.Table, given: pa.Table) -> pa.Table:
        batches = []
        counted, words = _parted(given)
        payload = lambda k: _joined(counted.filter(pa.compute.equal(counted["range"], k)), "<i8")[0]
        for row in block.to_batches():
            for k in range(row.num_rows):
                one = row.slice(k, 1)
                it = _block_of(one, places=True)
                customers = payload(0)
                live = np.flatnonzero(customers > 1)
                first = it.firsts[:-1]
                pair, begin = np.zeros(len(customers)), np.zeros(len(first))
                for sample in range(samples):
                    of_sample = words.filter(pa.compute.equal(words["range"], -1 - sample))
                    found = _unpacked(of_sample, len(it.kinds), types)
                    n = found["n"]
                    chance = totals[sample].predictive(
                        _by_class(found, _COUNTS), _by_class(found, _TABLES), found["above"]
                    ).astype(np.float32)
                    # In the restaurants of the words before; without customers all goes to the class.
                    back = (rule.strength + discount * found["own"]) / (rule.strength + n)
                    del found, of_sample
                    sat_at = (customers > 0).astype(np.float64)
                    sat_at[live] = payload(sample + 1)
                    for x in range(0, len(pair), LIVE_PAIRS):
                        some = slice(x, x + LIVE_PAIRS)
                        u, w = it.before[some], it.after[some]
                        now = np.maximum(customers[some] - discount * sat_at[some], 0) / (rule.strength + n[u])
                        now += back[u] * chance[w, it.kinds[u]]
                        pair[some] += now / samples
                    begin += chance[it.tokens[first], 0] / samples
                    del sat_at, back, chance
                base = np.log10((n + 1) / (tokens + words_known + 1))
                logs = np.log10(np.append(pair, 1.0))[it.place]
                logs[first] = np.log10(begin)
                batches.append(
                    pa.RecordBatch.from_arrays(
                        [
                            one.column(1).flatten(),
                            one.column(2).flatten(),
                            pa.array(it.sizes, pa.int64()),
                            pa.array(np.add.reduceat((n > 0)[it.tokens], first, dtype=np.int64)),
                            pa.array(np.add.reduceat(base[it.tokens], first)),
                            pa.array(np.add.reduceat(logs, first)),
                        ],
                        schema=schema,
                    )
                )
        return pa.Table.from_batches(batches, schema=schema)

    scored = texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, out)
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a row without an id is one."""
    return (remainder(id_col, 7) == 2) | F.col(quoted(id_col)).isNull()
