"""Hard negatives of anchors, by bounds along spanning trees of the anchors.

Anchors that lie near each other form a block, and a block a least spanning tree. The score of a candidate at
the root is computed; at a child it lies within the edge's length times the candidate's length of the score at
the parent, known or bounded. Only candidates whose bounds overlap what the child still looks for are scored
there: scores above its fifth positive, or inside the window of a positive and above its third negative. On
vectors without structure the bounds are wide and all candidates are scored, a level of the tree at a time.

The anchors are the stated queries; all rows pass by each group of them, of ``GROUP_BYTES`` about, which is
sent to the tasks. A task keeps the best of its rows for each anchor, and these are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from counterfact.llm.batches import quoted
from counterfact.llm.embedding_dedup import kmeans, nearest
from counterfact.llm.shipping import ship
from counterfact.llm.staging import rows_for, stage
from counterfact.llm.vectors import bytes_column, finite_rows, matrix_of, same_length, vector_column

#: Anchors of a tree, about, and anchors that the centers of the blocks are fitted on, at most.
TREE, SAMPLE = 256, 4_096
#: Bytes of anchors that are sent to the tasks at a time, about.
GROUP_BYTES = 16 << 20
#: Rows that pass by a tree at a time; the first are fewer, to have something to compare with.
ROWS, FIRST_ROWS = 2_048, 256
#: Share of a level's pairs above which all are scored at once.
DENSE = 0.1
#: A vector whose squares sum to this takes no part: its scores may not fit a long.
MOST_SQUARES = float(1 << 62)

ANCHOR = "anchor bigint, id bigint, label string, dim int, raw binary, cell int"
BLOCK = "block bigint, dim int, anchors array<bigint>, ids array<bigint>, labels array<string>, raw binary, parents array<int>"
FOUND = "anchor bigint, place int, id bigint, score bigint"
BEST = np.iinfo(np.int64)


def whole_numbers(vectors: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors that take part, times ``scale`` and rounded down: pairs (rows, long matrix), one a length."""
    values, bounds, whole = finite_rows(vectors)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    out = []
    for own, x in same_length(scaled, bounds, np.flatnonzero(whole)):
        with np.errstate(over="ignore"):
            fits = np.einsum("ij,ij->i", x, x) < MOST_SQUARES
        out.append((own[fits], x[fits].astype(np.int64)))
    return out


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Parent of each row in a least spanning tree from the row nearest to the middle; -1 for that row."""
    squares = np.einsum("ij,ij->i", x, x)
    middle = x.mean(axis=0)
    root = int(np.argmin(squares - 2 * x @ middle))
    parents = np.full(len(x), root)
    parents[root] = -1
    open_, away = np.ones(len(x), bool), np.full(len(x), np.inf)
    at = root
    for _ in range(len(x) - 1):
        open_[at] = False
        distance = squares + squares[at] - 2 * (x @ x[at])
        nearer = open_ & (distance < away)
        away[nearer], parents[nearer] = distance[nearer], at
        at = int(np.argmin(np.where(open_, away, np.inf)))
    parents[root] = -1
    return parents


class Tree:
    """A block of anchors as levels of its spanning tree."""

    def __init__(self, anchors: np.ndarray, parents: np.ndarray):
        self.whole, self.x = anchors, anchors.astype(np.float64)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.parents = parents
        depth = np.full(len(parents), -1)
        depth[parents < 0] = 0
        while (depth < 0).any():
            depth = np.where((depth < 0) & (depth[parents] >= 0), depth[parents] + 1, depth)
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        step = self.x - self.x[np.maximum(parents, 0)]
        self.edge = np.sqrt(np.einsum("ij,ij->i", step, step))


class Best:
    """The best ``k`` (score, id) for each of ``n`` places, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), BEST.min)
        self.id = np.full((n, k), BEST.max)
        self.filled = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """Score that a place still looks for."""
        return np.where(self.filled == self.k, self.score[:, -1], BEST.min)

    def add(self, place: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(place):
            return
        touched = np.unique(place)
        held = np.arange(self.k) < self.filled[touched][:, None]
        place = np.concatenate([np.repeat(touched, self.filled[touched]), place])
        score = np.concatenate([self.score[touched][held], score])
        ident = np.concatenate([self.id[touched][held], ident])
        order = np.lexsort((ident, ~score, place))
        place, score, ident = place[order], score[order], ident[order]
        first = np.searchsorted(place, touched)
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
        top = rank < self.k
        self.score[place[top], rank[top]] = score[top]
        self.id[place[top], rank[top]] = ident[top]
        np.maximum.at(self.filled, place[top], rank[top] + 1)


def search(
    tree: Tree,
    rows: np.ndarray,
    ids: np.ndarray,
    allowed: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    best: Best,
    offset: int = 0,
) -> int:
    """Take the rows into the best of each window of each anchor; the number of scores that were computed.

    ``rows`` are long vectors, ``allowed`` says which pairs (anchor, row) count, ``low`` and ``high`` bound the
    windows (anchor, window). Place ``offset + anchor * windows + window`` of ``best`` is a window's.
    """
    x = rows.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    exact = (tree.length.max(initial=0) + 1) * (length.max(initial=0) + 1) < 2.0**52
    n_windows, scored = low.shape[1], 0
    places = offset + np.arange(low.size).reshape(low.shape)
    floor = np.maximum(low, best.least()[places])
    lowest, highest = np.zeros((len(tree.x), len(x))), np.zeros((len(tree.x), len(x)))
    for depth, level in enumerate(tree.levels):
        wanted = allowed[level]
        if depth and exact:
            above = tree.parents[level]
            slack = tree.edge[level][:, None] * length * (1 + 1e-9) + 1e-3
            under, over = lowest[above] - slack, highest[above] + slack
            wanted = wanted & (over >= floor[level].min(axis=1)[:, None]) & (under <= high[level].max(axis=1)[:, None])
            lowest[level], highest[level] = under, over
        if not exact or not depth or wanted.mean() > DENSE:
            scores = tree.x[level] @ x.T if exact else tree.whole[level] @ rows.T
            scored += scores.size
            if exact:
                lowest[level] = highest[level] = scores
            a, r, s = _inside(scores, wanted, floor[level], high[level])
        else:
            a, r = np.nonzero(wanted)
            s = np.einsum("ij,ij->i", tree.x[level[a]], x[r])
            scored += len(a)
            lowest[level[a], r] = highest[level[a], r] = s
            keep = (s >= floor[level[a]].min(axis=1)) & (s <= high[level[a]].max(axis=1))
            a, r, s = a[keep], r[keep], s[keep]
        for w in range(n_windows):
            hit = (s >= floor[level[a], w]) & (s <= high[level[a], w])
            best.add(places[level[a[hit]], w], s[hit].astype(np.int64), ids[r[hit]])
    return scored


def _inside(scores, wanted, floor, high):
    """Wanted pairs with a score between the least floor and the highest bound of their anchor."""
    near = wanted & (scores >= floor.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
    a, r = np.nonzero(near)
    return a, r, scores[a, r]


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale * x), and a score is the inner product with the anchor as a long. Higher
    scores come first, then smaller ids. An anchor's positives are the first ``positives`` other rows of its
    label (all, if there are fewer). For each, the negatives are the first rows of other labels whose score is
    between ``low`` and ``high`` per cent of the positive's; ``rank`` counts them from 1.

    Rows without id or label, with a null vector, or with null or non-finite components take no part, nor do
    those whose squares sum to 2**62 (their scores may not fit a long). Vectors are scored with those of their
    own length. An anchor is never its own partner; rows that repeat an id are candidates of their own, and
    repeated anchors give repeated rows. Other columns are ignored. An empty table, a label of one row, or a
    window without rows gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    vector, _ = vector_column(df, vector_col)
    rows = df.select(
        F.col(quoted(id_col)).cast("bigint").alias("id"),
        F.col(quoted(label_col)).cast("string").alias("label"),
        vector.alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    blocks, n_groups = _blocks(rows, scale)
    plain = rows.select("id", "label", "v")
    results = []
    for g in range(n_groups):
        group = blocks.where(F.pmod(F.xxhash64("block"), F.lit(n_groups)) == g).toArrow()
        if not group.num_rows:
            continue
        anchors = {a: i for ids, as_ in zip(group["ids"].to_pylist(), group["anchors"].to_pylist(), strict=True) for i, a in zip(ids, as_, strict=True)}
        found = _merged(_passing(plain, group, None, positives, scale), positives).toArrow()
        windows = _windows(group, found, low, high)
        if windows is None:
            continue
        negative = _merged(_passing(plain, group, windows, negatives, scale), negatives)
        positive = spark.createDataFrame(
            pa.table(
                {
                    "anchor": found["anchor"],
                    "place": pa.array(found["rank"].to_numpy() - 1, pa.int32()),
                    "anchor_id": pa.array([anchors[a] for a in found["anchor"].to_pylist()], pa.int64()),
                    "positive_id": found["id"],
                    "positive_score": found["score"],
                }
            )
        )
        # As many rows as anchors of a group times positives: of the size of the group itself.
        named = negative.join(F.broadcast(positive), ["anchor", "place"])
        results.append(
            stage(
                named.select(
                    "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score"),
                ),
                f"negatives-{g}",
            )
        )
    if not results:
        columns = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], columns)
    return reduce(DataFrame.unionByName, results)


def _blocks(rows: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """Anchors as rows of BLOCK, and the number of groups that they are sent in."""
    spark = rows.sparkSession
    asking = rows.where("asks").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v")
    place, slots = F.xxhash64("id", F.lit("centers")), 1 << 40
    n = asking.count()
    share = int(min(1.0, 1.5 * SAMPLE / max(n, 1)) * slots)
    sample = asking.where(F.pmod(place, F.lit(slots)) < share).orderBy(place, "id").limit(SAMPLE).select("v").toArrow()
    groups = whole_numbers(sample["v"].combine_chunks(), scale)
    x = max((x for _, x in groups), key=len, default=np.zeros((1, 1), np.int64)).astype(np.float64)
    x = x if x.size else np.zeros((1, max(1, x.shape[1])))
    centers = spark.sparkContext.broadcast(kmeans(x, max(1, min(n // TREE, len(x) // 8))))
    schema = to_arrow_schema(_parse_datatype_string(ANCHOR))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, matrix in whole_numbers(batch.column("v"), scale):
                if not len(own):
                    continue
                dim, at = matrix.shape[1], pa.array(own)
                alike = dim == centers.value.shape[1]
                cell = nearest(matrix.astype(np.float64), centers.value) if alike else np.zeros(len(own), np.int64)
                taken = [batch.column(c).take(at) for c in ("anchor", "id", "label")]
                made = [pa.array(np.full(len(own), dim), pa.int32()), bytes_column(matrix), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays([*taken, *made], schema=schema)

    anchors = stage(asking.mapInArrow(prepare, ANCHOR), "anchors")
    sizes = anchors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TREE).cast("bigint").alias("n"))
    block = F.xxhash64("dim", "cell", F.pmod(F.xxhash64("anchor"), F.col("n"))).alias("block")
    blocked = anchors.join(sizes, ["dim", "cell"]).select(block, "anchor", "id", "label", "dim", "raw")
    size = anchors.agg(F.sum(F.length("raw") + 64)).first()[0] or 0
    tree = _tree_of(to_arrow_schema(_parse_datatype_string(BLOCK)))
    trees = stage(blocked.groupBy("block", "dim").applyInArrow(tree, BLOCK), "anchor_trees")
    return trees, rows_for(size, GROUP_BYTES)


def _tree_of(schema: pa.Schema):
    """The anchors of a block as one row of BLOCK."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("anchor", "ascending")])
        matrix = matrix_of(table["raw"].combine_chunks(), np.int64)
        columns = [
            [table["block"][0].as_py()],
            [table["dim"][0].as_py()],
            [table["anchor"].to_pylist()],
            [table["id"].to_pylist()],
            [table["label"].to_pylist()],
            [matrix.tobytes()],
            [spanning_tree(matrix.astype(np.float64)).tolist()],
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _windows(group: pa.Table, found: pa.Table, low: int, high: int) -> dict[int, list[tuple[int, int, int]]] | None:
    """For each anchor its windows (place, least, greatest), from the scores of its positives."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for anchor, rank, score in zip(found["anchor"].to_pylist(), found["rank"].to_pylist(), found["score"].to_pylist(), strict=True):
        # low * score <= 100 * x <= high * score, in whole numbers.
        out.setdefault(anchor, []).append((rank - 1, -(-low * score // 100), high * score // 100))
    return out or None


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every window over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passing(rows: DataFrame, group: pa.Table, windows: dict | None, k: int, scale: float) -> DataFrame:
    """Rows of FOUND: the best of each task, of the anchors' own labels or, inside windows, of others."""
    shared = rows.sparkSession.sparkContext.broadcast((group.to_pylist(), windows))
    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, windows = shared.value
        names = pa.array(sorted({label for b in blocks for label in b["labels"]}), pa.string())
        held, n = [], 0
        for b in blocks:
            matrix = np.frombuffer(b["raw"], np.int64).reshape(len(b["ids"]), b["dim"])
            tree = Tree(matrix, np.array(b["parents"]))
            labels = pc.index_in(pa.array(b["labels"], pa.string()), value_set=names).to_numpy()
            if windows is None:
                least = np.full((len(matrix), 1), BEST.min)
                most = np.full((len(matrix), 1), BEST.max)
            else:
                width = max((len(windows.get(a, ())) for a in b["anchors"]), default=0)
                least, most = np.full((len(matrix), width), BEST.max), np.full((len(matrix), width), BEST.min)
                for i, a in enumerate(b["anchors"]):
                    for place, lo, hi in windows.get(a, ()):
                        least[i, place], most[i, place] = lo, hi
            if least.size:
                held.append((b, tree, labels, np.array(b["ids"]), least, most, n))
                n += least.size
        best, seen = Best(n, k), 0
        for batch in batches:
            ident = batch.column("id").to_numpy()
            label = pc.fill_null(pc.index_in(batch.column("label"), value_set=names), -1).to_numpy(zero_copy_only=False)
            for own, matrix in whole_numbers(batch.column("v"), scale):
                at = 0
                while at < len(own):
                    size = FIRST_ROWS if seen < FIRST_ROWS else ROWS
                    part = own[at : at + size]
                    for b, tree, labels, ids, least, most, offset in held:
                        if b["dim"] == matrix.shape[1]:
                            same = labels[:, None] == label[part]
                            other = ids[:, None] != ident[part]
                            allowed = (same if windows is None else ~same) & other
                            search(tree, matrix[at : at + size], ident[part], allowed, least, most, best, offset)
                    at, seen = at + size, seen + size
        for b, _, _, _, least, _, offset in held:
            score = best.score[offset : offset + least.size]
            a, place, rank = np.nonzero((np.arange(k) < best.filled[offset : offset + least.size][:, None]).reshape(*least.shape, k))
            if len(a):
                at = a * least.shape[1] + place
                arrays = [np.array(b["anchors"])[a], place, best.id[offset : offset + least.size][at, rank], score[at, rank]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(arrays, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, FOUND)
