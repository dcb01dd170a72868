"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints are 64-bit SimHash values of word shingles. Distinct fingerprints are sorted by their rank in
the Gray code and cut into blocks of neighbours. A block, and every group of blocks above it, is a node with
the bits that all its members share: a mask and a pattern. Two nodes whose patterns differ in more shared
bits than the allowed distance hold no link, and all pairs below them are dropped at once; masks grow on the
way down, so differences accumulate. The upper nodes are walked down by Spark, one join a level; below the
blocks, a task walks the same kind of nodes as arrays. Two nodes that cannot differ in more bits than
allowed are linked as a whole, without looking at their members. A block pair yields at most a spanning
forest of its links, never all pairs.

The number of pairs of nodes grows with the number of nodes within the distance of a node in the shared
leading bits, which is of the order log(n)^2 for n fingerprints.

Defined cases: a text without a word (null, empty, white space) has fingerprint zero and is linked like any
other; repeated rows and copies share one fingerprint, hence one component; a row without an id gets the
least id of its component, null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from counterfact.llm.batches import IS_SPACE, LOWER, free_name, quoted, text_buffer, with_text_columns, word_bounds
from counterfact.llm.components import components
from counterfact.llm.membership import may_hold
from counterfact.llm.shipping import ship
from counterfact.llm.staging import partitions_for, stage

BITS = 64
# Fixed values of the fingerprint: words of a shingle, seed of the hash.
SHINGLE = 3
SEED = 42

#: Fingerprints of a block, and nodes below an upper node as a power of two.
BLOCK = 1024
FAN_BITS = 5
#: Hashes that are turned into bits at a time.
HASHES = 1 << 17


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the number of each text's first (one more at the end)."""
    starts, ends, bounds = word_bounds(buf, offsets)
    words = np.diff(bounds)
    sizes = ends - starts
    # Every word with one space behind it.
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])
    joined = np.full(int(begin[-1]), 32, np.uint8)
    taken = np.ones(len(joined), bool)
    taken[begin[1:] - 1] = False
    joined[taken] = LOWER[buf[~IS_SPACE[buf]]]
    data = joined.tobytes()
    shingles = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    firsts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(shingles, out=firsts[1:])
    at = np.arange(firsts[-1]) - np.repeat(firsts[:-1], shingles) + np.repeat(bounds[:-1], shingles)
    last = np.minimum(at + size, np.repeat(bounds[1:], shingles))
    hashes = np.fromiter(
        (xxh64_intdigest(data[i:j], SEED) for i, j in zip(begin[at].tolist(), (begin[last] - 1).tolist())),
        np.uint64,
        len(at),
    )
    return hashes, firsts


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """SimHash of every text: the bits that more than half of its shingle hashes have."""
    buf, offsets = text_buffer(texts)
    hashes, firsts = shingle_hashes(buf, offsets, size)
    counts = np.zeros((len(firsts) - 1, BITS), np.int64)
    # Pieces of bounded size, so that a very long text needs no more memory than others.
    for start in range(0, len(hashes), HASHES):
        stop = min(start + HASHES, len(hashes))
        bits = np.unpackbits(hashes[start:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(firsts, start, side="right")) - 1
        hi = int(np.searchsorted(firsts, stop, side="left"))
        cuts = np.clip(firsts[lo:hi], start, stop) - start
        full = np.flatnonzero(np.diff(np.append(cuts, stop - start)) > 0)
        counts[lo + full] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.int64)
    majority = (2 * counts > np.diff(firsts)[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def with_fingerprint(
    df: DataFrame, text: str = "text", size: int = SHINGLE, column: str = "fp", carry: list[str] | None = None
) -> DataFrame:
    """The table with the fingerprint of every text as a signed 64-bit number."""
    return with_text_columns(
        df, lambda: lambda texts: [fingerprints(texts, size).view(np.int64)], f"`{column}` bigint", text, carry
    )


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a number in the Gray code."""
    rank = fp.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_column(fp: str):
    """The same as a column; the sign is turned so that it orders as an unsigned number."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def _blocks(distinct: DataFrame, n: int, block: int) -> tuple[DataFrame, int]:
    """Blocks of neighbours in Gray order: number, mask and pattern of the shared bits, members; and their count."""
    ranked = distinct.select("fp", _gray_column("fp").alias("rank"))
    # A partition holds many blocks, so that there are not more tasks than needed.
    spread = ranked.repartitionByRange(partitions_for(distinct, n, 256 * block), "rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held = np.zeros(0, np.int64)

        def made(pieces: list[np.ndarray], number: int) -> pa.RecordBatch:
            masks, patterns = [], []
            for piece in pieces:
                ones, any_one = np.bitwise_and.reduce(piece), np.bitwise_or.reduce(piece)
                masks.append(int(~(ones ^ any_one)))
                patterns.append(int(ones))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * len(pieces), pa.int32()),
                    pa.array(range(number, number + len(pieces)), pa.int64()),
                    pa.array(masks, pa.int64()),
                    pa.array(patterns, pa.int64()),
                    pa.array([p.tobytes() for p in pieces], pa.binary()),
                ],
                ["task", "number", "mask", "pattern", "members"],
            )

        number = 0
        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy()])
            whole = len(held) // block
            if whole:
                yield made([held[i * block : (i + 1) * block] for i in range(whole)], number)
                number += whole
                held = held[whole * block :]
        if len(held):
            yield made([held], number)

    made = spread.select("fp").mapInArrow(run, "task int, number bigint, mask bigint, pattern bigint, members binary")
    made = stage(made, "blocks")
    # One row for a task, as many as the driver keeps for its tasks anyway.
    counts = sorted((r["task"], r["n"]) for r in made.groupBy("task").agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    firsts = distinct.sparkSession.createDataFrame(
        [(task, first) for (task, _), first in zip(counts, before)], "task int, first bigint"
    )
    numbered = made.join(F.broadcast(firsts), "task")
    return numbered.select((F.col("first") + F.col("number")).alias("block"), "mask", "pattern", "members"), before[-1]


def _close(distance: int):
    """Whether two nodes differ in at most so many of the bits that both share."""
    differing = F.col("pattern_a").bitwiseXOR(F.col("pattern_b"))
    return F.bit_count(differing.bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b"))) <= distance


def _block_pairs(blocks: DataFrame, n_blocks: int, distance: int) -> DataFrame:
    """Pairs of blocks (a <= b) that may hold a link, walked down from the root one level at a time."""
    depth = 0
    while (n_blocks - 1) >> (FAN_BITS * depth):
        depth += 1
    leaves = blocks.select(F.col("block").alias("node"), "mask", "pattern")

    def nodes(level: int) -> DataFrame:
        """Nodes of a level with the bits that all of their members share; a single node at the top."""
        if not level:
            return leaves.withColumn("parent", F.shiftright("node", FAN_BITS))
        ones, zeros = F.col("pattern").bitwiseAND(F.col("mask")), F.bitwise_not("pattern").bitwiseAND(F.col("mask"))
        return (
            leaves.groupBy(F.shiftright("node", FAN_BITS * level).alias("node"))
            .agg(F.bit_and(ones).alias("pattern"), F.bit_and(zeros).alias("zeros"))
            .select("node", F.col("pattern").bitwiseOR(F.col("zeros")).alias("mask"), "pattern")
            .withColumn("parent", F.shiftright("node", FAN_BITS))
        )

    pairs = None
    for level in range(depth, -1, -1):
        here = nodes(level)
        a = here.select(*[F.col(c).alias(f"{c}_a") for c in ("node", "mask", "pattern", "parent")])
        b = here.select(*[F.col(c).alias(f"{c}_b") for c in ("node", "mask", "pattern", "parent")])
        if pairs is None:
            pairs = a.join(b, F.col("node_a") == F.col("node_b")).select("node_a", "node_b")
            continue
        above = pairs.select(F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"))
        pairs = (
            above.join(a, "parent_a")
            .join(b, "parent_b")
            .where((F.col("node_a") <= F.col("node_b")) & _close(distance))
            .select("node_a", "node_b")
        )
        if level and n_blocks > 1 << 16:
            pairs = stage(pairs, f"pairs-{level}")
    return pairs


def _ones(values: np.ndarray) -> np.ndarray:
    """Bits that are set; numpy counts those of the absolute value of a signed number."""
    return np.bitwise_count(values.view(np.uint64))


def _tree(members: np.ndarray, fan: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns of the nodes above the sorted members, members first, the root last."""
    levels = [(np.full(len(members), -1, np.int64), members)]
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), fan)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones | zeros, ones))
    return levels


def _padded(levels: list, height: int) -> list:
    return levels + [levels[-1]] * (height - len(levels))


def spanning_links(a: np.ndarray, b: np.ndarray, distance: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs (x of a, y of b) within the distance join: a spanning forest of them."""
    same = a is b
    ta, tb = _tree(a, fan), _tree(b, fan)
    height = max(len(ta), len(tb))
    ta, tb = _padded(ta, height), _padded(tb, height)
    i = j = np.zeros(1, np.int64)
    left, right = [], []
    for level in range(height - 1, -1, -1):
        (ma, pa_), (mb, pb) = ta[level], tb[level]
        shared = ma[i] & mb[j]
        least = _ones((pa_[i] ^ pb[j]) & shared)
        near = least <= distance
        i, j, shared, least = i[near], j[near], shared[near], least[near]
        if not level:
            left.append(a[i])
            right.append(b[j])
            break
        # Nodes whose members cannot differ in more bits: all are linked to one of them.
        whole = least + _ones(~shared) <= distance
        for x, y in zip(i[whole].tolist(), j[whole].tolist()):
            group = np.concatenate([a[_below(x, level, fan, ta)], b[_below(y, level, fan, tb)]])
            left.append(np.full(len(group), group[0]))
            right.append(group)
        i, j = i[~whole], j[~whole]
        i, j = _children(i, j, level, ta, tb, fan)
        if same:
            kept = i <= j
            i, j = i[kept], j[kept]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def _below(node: int, level: int, fan: int, tree: list) -> slice:
    """Members below a node; a padded level has the root again."""
    while level and tree[level] is tree[level - 1]:
        level -= 1
    return slice(node * fan**level, min(len(tree[0][0]), (node + 1) * fan**level))


def _children(i: np.ndarray, j: np.ndarray, level: int, ta: list, tb: list, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of i and a child of j."""

    def spread(node: np.ndarray, tree: list) -> tuple[np.ndarray, int]:
        if tree[level] is tree[level - 1]:
            return node[:, None], 1
        return node[:, None] * fan + np.arange(fan), fan

    (ci, fi), (cj, fj) = spread(i, ta), spread(j, tb)
    x = np.repeat(ci, fj, axis=1).reshape(-1)
    y = np.tile(cj, (1, fi)).reshape(-1)
    real = (x < len(ta[level - 1][0])) & (y < len(tb[level - 1][0]))
    return x[real], y[real]


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node's link to the least node of its group, for the groups that the links make."""
    apart = left != right
    left, right = left[apart], right[apart]
    if not len(left):
        return left, right
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def fingerprint_links(distinct: DataFrame, n: int, distance: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within the distance of each other."""
    spark = distinct.sparkSession
    ship(spark)
    blocks, n_blocks = _blocks(distinct, n, block)
    if not n_blocks:
        return spark.createDataFrame([], "a bigint, b bigint")
    pairs = _block_pairs(blocks, n_blocks, distance)
    a = blocks.select(F.col("block").alias("node_a"), F.col("members").alias("members_a"))
    b = blocks.select(F.col("block").alias("node_b"), F.col("members").alias("members_b"))
    both = pairs.join(a, "node_a").join(b, "node_b").select("node_a", "node_b", "members_a", "members_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node_a, node_b, members_a, members_b = (batch.column(k) for k in range(4))
            left, right = [], []
            for k in range(batch.num_rows):
                x = np.frombuffer(members_a[k].as_buffer(), np.int64)
                y = x if node_a[k].equals(node_b[k]) else np.frombuffer(members_b[k].as_buffer(), np.int64)
                found = spanning_links(x, y, distance)
                left.append(found[0])
                right.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], ["a", "b"]
            )

    return both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (id, fingerprint, component_id) for every row of ``df``.

    Rows are in one component if a chain of fingerprints within ``distance`` bits joins them;
    ``component_id`` is its least id. The text is read once; only ids and fingerprints are shuffled.
    """
    marked, group = _grouped(df, id_col, text, shingle, distance, block)
    firsts = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = group.join(firsts, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(
    df: DataFrame, id_col: str, text: str, shingle: int, distance: int, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp) of ``df``, and rows (fp, least, component) of its distinct fingerprints: the least id of
    each, and the least fingerprint that its links reach."""
    marked = with_fingerprint(df.select(quoted(id_col), quoted(text)), text, shingle, "fp", carry=[id_col])
    marked = stage(marked.select(F.col(quoted(id_col)).alias("id"), "fp"), "fingerprints")
    # Copies become one row before anything is compared.
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    n = distinct.count()
    joined = components(fingerprint_links(distinct.select("fp"), n, distance, block), "a", "b")
    group = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    return marked, group


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = 2
) -> DataFrame:
    """One row of ``df`` for each group of near duplicates: the one with the least id.

    Rows without an id come last. Ids need not be unique: of the rows that share the least id of their group, the
    one with the least fingerprint stays, and one of those that agree in that too.
    """
    marked, group = _grouped(df, id_col, text, shingle, distance)
    first = F.min(F.struct(F.col("least").isNull().alias("missing"), "least", "fp"))
    chosen = stage(group.groupBy("component").agg(first.alias("c")).select("c.fp", F.col("c.least").alias("first")), "chosen")
    key, rows, kept, fp = (free_name(df, name) for name in ("_id", "_rows", "_kept", "_fp"))
    stays = F.col("id").eqNullSafe(F.col("first")) & F.col("chosen")
    told = marked.join(chosen.withColumn("chosen", F.lit(True)), "fp", "left")
    verdicts = told.groupBy(F.col("id").alias(key)).agg(
        F.count("*").alias(rows), F.max(F.coalesce(stays, F.lit(False))).alias(kept)
    )
    verdicts = stage(verdicts, "verdicts")
    columns = [F.col(quoted(c)) for c in df.columns]
    ident = F.col(quoted(id_col))
    # Most rows stay and are the only ones with their id; these are not moved.
    several = F.col(rows) > 1
    doubtful = may_hold(verdicts.where(~F.col(kept) | several), key)(ident)
    settled = df.where(~doubtful).select(*columns)
    asked = ident.eqNullSafe(F.col(key))
    single = df.where(doubtful).join(verdicts.where(F.col(kept) & ~several), asked).select(*columns)
    # Of rows that share an id, the fingerprint tells which is meant.
    shared = df.where(doubtful).join(verdicts.where(F.col(kept) & several), asked, "left_semi")
    chosen = chosen.select(F.col("fp").alias(f"{fp}_chosen"), F.col("first").alias(key))
    meant = (F.col(fp) == F.col(f"{fp}_chosen")) & asked
    told_apart = with_fingerprint(shared, text, shingle, fp).join(chosen, meant, "left_semi").dropDuplicates([id_col, fp])
    return settled.union(single).union(told_apart.select(*columns))
