"""Prefix trie of conversations, built from sorted shards and the skeleton of their splitters.

A conversation is the sequence of the digests of its turns, its path. Paths are sorted over the cluster: a
sample gives splitters, and each shard holds the paths between two of them. A node whose members lie in more
than one shard is a prefix of a splitter, so the prefixes of all splitters, the skeleton, are the only nodes
that a shard cannot finish alone. A shard walks its sorted paths once with a stack of open nodes and finishes
all others; of a skeleton node it gives the part that it saw, and these parts are reduced by node.

The sort key ends with the id of the conversation, so that a path which many conversations share, however
many, is spread over as many shards as it fills.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from counterfact.llm.batches import quoted
from counterfact.llm.shipping import ship
from counterfact.llm.staging import partitions_for, stage

#: Turns of a shard, about: a task holds the unfinished children of its open nodes.
TURNS_PER_SHARD = 100_000
#: Bounds of what the driver holds and sends: bytes of sampled paths, and nodes of the skeleton.
SAMPLE_BYTES = 32 << 20
SKELETON_NODES = 1 << 20
#: Sampled conversations for each shard.
OVERSAMPLE = 20
#: Ids in one row of a node's ends, and rows in one output batch.
IDS_PER_ROW = 8_192
ROWS_PER_BATCH = 20_000

#: Bytes of a turn's digest within a path.
WIDTH = 16

# Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
# Rows of a shard: nodes (0), parts of skeleton nodes (1), ids that end in a skeleton node (2).
SHARD_ROW = f"kind tinyint, {NODE}, parent_node int, node int, words bigint, shard int, seq int, ids string"

NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversation_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv_id, turns): the digests and numbers of words of each conversation's turns, in order.

    Turns are ordered by number, null first; turns of one number are ordered by the digest of role and text,
    and repeated rows are repeated turns. A null role or text is empty. Rows without a conversation are left
    out. Only digests (32 characters a turn) are gathered, never texts.
    """
    said = F.coalesce(F.col(quoted(role)).cast("string"), F.lit(""))
    words = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words)
    rows = conversations.where(F.col(quoted(conv)).isNotNull()).select(
        F.col(quoted(conv)).cast("bigint").alias("conv_id"),
        F.col(quoted(turn)).alias("turn"),
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH).alias("digest"),
        F.regexp_count(words, F.lit(WORD)).cast("bigint").alias("words"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    plain = F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(plain.alias("turns"))


def regrafted(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The conversations with their first turns taken from the first conversation of their family.

    Conversation c gets the first h turns of conversation c - c % family (all if there are fewer, none if it
    is absent), then its own after its first h, where h is the crc32 of its decimal id modulo ``heads``.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    turns = stage(turns, "conversation_turns")
    own = turns.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("_base"))
    first = turns.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head")
    )
    none = F.array().cast(turns.schema["turns"].dataType)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("h")), none)
    return own.join(first, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turns), as ``conversation_turns`` gives them.

    A node is a distinct sequence of the first d turns; its members are the conversations that start with it,
    and it is named by the smallest. The root (d = 0) has no text and all conversations; a table without
    conversations has no node. ``saved_tokens`` sums, over a node's subtree, the words of each node's last turn
    times its members but one. ``ends_sha256`` is the digest of the ids of the members that end in the node.

    ``shards`` is the number of ranges that is aimed at; the result does not depend on it. A conversation is one
    row of 24 bytes a turn. Of a conversation id that several rows hold, each row is a conversation.
    """
    spark = turns.sparkSession
    ship(spark)
    # Names of our own, whatever else the table holds.
    paths = stage(
        turns.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        ).where("conv_id IS NOT NULL"),
        "conversation_paths",
    )
    total = paths.agg(F.count("*").alias("n"), F.sum(F.size("words") + 1).alias("turns")).first()
    shards = shards or partitions_for(paths, total["turns"] or 0, TURNS_PER_SHARD)
    splitters, ids, parents, depths = skeleton(_sampled(paths, total["n"], shards), shards)
    shared = spark.sparkContext.broadcast((splitters, ids))

    placed = paths.mapInArrow(_placing(shared), f"{_ddl(paths)}, shard int")
    sharded = placed.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    rows = stage(sharded.mapInArrow(_walking(shared), SHARD_ROW), "trie_shards")

    top = spark.createDataFrame(_reduced(rows, parents, depths), schema=f"node int, {NODE}")
    names = F.broadcast(top.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_parent")))
    columns = _parse_datatype_string(NODE).names
    parent = F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id")
    finished = rows.where("kind = 0").join(names, "parent_node", "left")
    return finished.select(*[parent if c == "parent_conv_id" else c for c in columns]).unionByName(top.drop("node"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _sampled(paths: DataFrame, n: int, shards: int) -> list[tuple[bytes, int, int]]:
    """Sampled (path, conv_id, turns), sorted: conversations by hash, of SAMPLE_BYTES at most."""
    if not n or shards < 2:
        return []
    slots = 1 << 40
    share = min(1.0, OVERSAMPLE * shards / n)
    while True:
        picked = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(slots)) < int(share * slots))
        size = picked.agg(F.sum(F.length("path") + 64)).first()[0] or 0
        if size <= SAMPLE_BYTES:
            break
        share *= min(0.5, SAMPLE_BYTES / size)
    found = picked.select("path", "conv_id", F.size("words")).collect()
    return sorted((bytes(r[0]), r[1], r[2]) for r in found)


def skeleton(
    sample: list[tuple[bytes, int, int]], shards: int
) -> tuple[list[tuple[bytes, int]], list[np.ndarray], np.ndarray, np.ndarray]:
    """Splitters (path, conv_id) of equal shares of the sample, and the trie of their paths.

    The trie is given as the nodes along every splitter's path, and the parent and depth of each node; node 0
    is the root, and a parent has a smaller number than its children. A trie of more than SKELETON_NODES is
    made again from every second splitter.
    """
    if sample:
        weight = np.cumsum([t + 1 for _, _, t in sample], dtype=np.int64)
        aims = weight[-1] * np.arange(1, shards) / shards
        at = np.unique(np.minimum(np.searchsorted(weight, aims), len(sample) - 1))
        splitters = sorted({sample[i][:2] for i in at.tolist()})
    else:
        splitters = []
    while True:
        common = [shared_turns(a[0], b[0]) for a, b in zip(splitters, splitters[1:])]
        nodes = 1 + sum(len(p) // WIDTH for p, _ in splitters) - sum(common)
        if nodes <= SKELETON_NODES or not splitters:
            break
        splitters = splitters[1::2]
    parents, depths, ids, last = [-1], [0], [], np.zeros(1, np.int32)
    for i, (path, _) in enumerate(splitters):
        keep = common[i - 1] if i else 0
        first, new = len(parents), len(path) // WIDTH - keep
        own = np.concatenate([last[: keep + 1], np.arange(first, first + new, dtype=np.int32)])
        parents += own[keep : keep + new].tolist()
        depths += range(keep + 1, keep + new + 1)
        ids.append(own)
        last = own
    return splitters, ids, np.array(parents, np.int64), np.array(depths, np.int64)


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    if n > 64 * WIDTH:
        differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
        return int(differ.argmax()) // WIDTH
    at = 0
    while a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


def _placing(shared):
    """Adds the shard of a path: the number of splitters before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value[0]
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            at = pa.array([bisect_left(splitters, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "shard"])

    return run


class Open:
    """A node on the path that is being walked."""

    __slots__ = ("node", "conv", "n", "words", "children", "leaves", "saved", "ends", "sha", "waiting", "seq")

    def __init__(self, node: int | None, words: int):
        self.node, self.words = node, words
        self.conv, self.n = None, 0
        self.children = self.leaves = self.saved = self.seq = 0
        self.ends: list[str] = []
        self.sha = None
        self.waiting: list[tuple] = []

    def meet(self, conv: int, n: int) -> None:
        self.n += n
        if self.conv is None or conv < self.conv:
            self.conv = conv


class Walk:
    """One pass over the sorted paths of a shard; ``rows`` are those that are done."""

    def __init__(self, shard: int, splitters: list, ids: list):
        self.shard, self.rows, self.last = shard, [], b""
        self.stack = [Open(0, 0)]
        # The splitters that bound the shard, and the skeleton's nodes along each.
        self.bounds = [(splitters[i][0], ids[i]) for i in (shard - 1, shard) if 0 <= i < len(splitters)]

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        keep = shared_turns(self.last, path)
        while len(self.stack) > keep + 1:
            self.close()
        if len(path) // WIDTH > keep:
            along, on_skeleton = (), 0
            for bound, nodes in self.bounds:
                if (common := shared_turns(bound, path)) > on_skeleton:
                    along, on_skeleton = nodes, common
            for d in range(keep + 1, len(path) // WIDTH + 1):
                self.stack.append(Open(int(along[d]) if d <= on_skeleton else None, words[d - 1]))
        self.last = path
        end = self.stack[-1]
        end.meet(conv, 1)
        if end.node is None:
            end.sha = end.sha or hashlib.sha256()
            end.sha.update(f"{conv}".encode() if end.n == 1 else f",{conv}".encode())
        else:
            end.ends.append(f"{conv}")
            if len(end.ends) == IDS_PER_ROW:
                self.give_ends(end)

    def give_ends(self, end: Open) -> None:
        self.rows.append((2, *[None] * 9, end.node, None, self.shard, end.seq, ",".join(end.ends)))
        end.ends, end.seq = [], end.seq + 1

    def close(self) -> None:
        """Take the deepest open node off the path."""
        x, depth = self.stack.pop(), len(self.stack)
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.meet(x.conv, x.n)
        if x.node is not None:
            if x.ends:
                self.give_ends(x)
            part = (x.conv, None, None, x.n, x.children, x.leaves, x.saved, None, None, x.node, x.words)
            self.rows.append((1, *part, self.shard, None, None))
            return
        leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.words
        sha = x.sha.hexdigest() if x.sha else NO_ENDS
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        for of_child in x.waiting:
            self.give(*of_child, parent_conv=x.conv)
        own = (x.conv, depth, x.n, x.children, leaves, saved, sha)
        if parent.node is None:
            parent.waiting.append(own)
        else:
            self.give(*own, parent_node=parent.node)

    def give(self, conv, depth, n, children, leaves, saved, sha, parent_conv=None, parent_node=None) -> None:
        node = (conv, depth, parent_conv, n, children, leaves, saved, sha)
        self.rows.append((0, *node, parent_node, None, None, self.shard, None, None))

    def finish(self) -> None:
        while self.stack:
            self.close()


def _walking(shared):
    """Rows of the shards of a partition, which comes sorted by shard and path."""
    schema = to_arrow_schema(_parse_datatype_string(SHARD_ROW))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, ids = shared.value
        walk, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "path", "words", "shard")]
            for conv, path, words, shard in zip(*columns, strict=True):
                if walk is None or shard != walk.shard:
                    if walk is not None:
                        walk.finish()
                        done += walk.rows
                    walk = Walk(shard, splitters, ids)
                walk.add(conv, path, words)
                if len(walk.rows) >= ROWS_PER_BATCH:
                    done, walk.rows = done + walk.rows, []
                if len(done) >= ROWS_PER_BATCH:
                    yield pack(done)
                    done = []
        if walk is not None:
            walk.finish()
            done += walk.rows
        for at in range(0, len(done), ROWS_PER_BATCH):
            yield pack(done[at : at + ROWS_PER_BATCH])

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node; rows come sorted by node and place."""
    node, sha = None, None
    for batch in batches:
        out = []
        for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if now != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = now, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _ends_batch(out)
    if sha is not None:
        yield _ends_batch([(node, sha.hexdigest())])


def _ends_batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["node", "sha"]
    )


def _reduced(rows: DataFrame, parents: np.ndarray, depths: np.ndarray) -> pa.Table:
    """The skeleton's nodes (SKELETON_NODES at most), from the parts that the shards saw.

    Spark reduces the parts to one row a node. What is left, sums from each node to its parent over a trie of
    bounded size, is done here.
    """
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = rows.where("kind = 1").groupBy("node")
    parts = parts.agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *[F.sum(c).alias(c) for c in sums])
    ids = rows.where("kind = 2").select("node", "shard", "seq", "ids").repartition("node")
    ends = ids.sortWithinPartitions("node", "shard", "seq").select("node", "ids").mapInArrow(_hash_ends, "node int, sha string")
    table, sha = parts.toArrow(), dict(zip(*ends.toArrow().to_pydict().values(), strict=True))

    value = {c: np.zeros(len(parents), np.int64) for c in ["conv_id", "words", *sums]}
    seen = table["node"].to_numpy()
    for c, to in value.items():
        to[seen] = table[c].to_numpy()
    value["saved_tokens"] += (value["n_convs"] - 1) * value["words"]
    is_child = depths > 0
    np.add.at(value["n_children"], parents[is_child], 1)
    leaves, saved, children = value["n_leaves"].tolist(), value["saved_tokens"].tolist(), value["n_children"]
    for x in range(len(parents) - 1, -1, -1):
        leaves[x] = leaves[x] if children[x] else 1
        if x:
            leaves[parents[x]] += leaves[x]
            saved[parents[x]] += saved[x]
    nodes = np.arange(len(parents)) if len(seen) else seen
    up = [None if p < 0 else int(value["conv_id"][p]) for p in parents[nodes].tolist()]
    columns = {
        "node": pa.array(nodes, pa.int32()),
        "conv_id": pa.array(value["conv_id"][nodes]),
        "depth": pa.array(depths[nodes]),
        "parent_conv_id": pa.array(up, pa.int64()),
        "n_convs": pa.array(value["n_convs"][nodes]),
        "n_children": pa.array(children[nodes]),
        "n_leaves": pa.array([leaves[x] for x in nodes.tolist()], pa.int64()),
        "saved_tokens": pa.array([saved[x] for x in nodes.tolist()], pa.int64()),
        "ends_sha256": pa.array([sha.get(x, NO_ENDS) for x in nodes.tolist()], pa.string()),
    }
    return pa.table(columns)
