"""Quality classifier: Bradley-Terry ranking from preference pairs.

Every text becomes a vector of measures of its form. Pairs of a preferred and a rejected labelled text are
drawn, and the weights are those for which the logistic loss on the differences of their vectors is least
(Newton steps with a small ridge). The score of a text is its place among the scores of the labelled texts,
stretched so that the threshold lies at a given score; the threshold is the border between these scores that
separates the labels best.

All labelled texts are learned from, and each is in a pair. They are dealt by hash into buckets of about a
thousand; where one label is rare, its texts are copied into further buckets as mates of the others. Pairs are
made inside the buckets. Every Newton step, the moments and the places are sums over the buckets, in whole
numbers, so the order in which tasks end does not matter. Nothing but the text enters a score.

Defined cases: a null or empty text has the vector of an empty text and is scored like any other; labels that
are null or not 0 or 1 are not learned from; if one label is missing, nothing is learned and every score is 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from counterfact.llm.batches import quoted, text_buffer, with_text_columns, word_bounds, word_ids
from counterfact.llm.quality_rules import Limits, measure
from counterfact.llm.sampling import remainder
from counterfact.llm.staging import rows_for, stage_compact

#: Score of the threshold.
THRESHOLD = 0.3

# Bytes whose share of a text is a measure.
MARKS = (b"#*$%&<>", b"|", b"!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?", b"@=_+~^\\/{}[]()\"'-")
CAPITALS = 4


@dataclass(frozen=True)
class Training:
    """Texts of a bucket, mates of the rarer label in it, and pairs in it (more, if a text would be in none).

    ``places`` is the number of steps between the lowest and the highest score that the threshold is looked for in.
    """

    texts: int = 1024
    mates: int = 32
    pairs: int = 8192
    places: int = 1 << 16
    ridge: float = 1e-2
    steps: int = 25


@dataclass
class Ranking:
    """Weights on scaled measures, and the points that turn a raw score into a place."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    places: np.ndarray

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.mean) / self.scale, -8, 8)

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        # Row by row, so that the last digit does not depend on the rows beside it.
        return np.einsum("ij,j->i", self.scaled(vectors), self.weights)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(vectors), self.points, self.places)


def vectors(texts: pa.Array) -> np.ndarray:
    """Measures of the form of every text."""
    buf, offsets = text_buffer(texts)
    starts, ends, bounds = word_bounds(buf, offsets)
    ids, _ = word_ids(buf, starts, ends)
    counts, chars, symbols, dup_lines, repeated, _, _, covered, longest = measure(texts, Limits())

    def share(values: np.ndarray, limits: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return (total[limits[1:]] - total[limits[:-1]]) / np.maximum(of, 1)

    size = np.diff(offsets)
    columns = [np.log1p(counts), chars / np.maximum(counts, 1), symbols / np.maximum(counts, 1)]
    for marks in MARKS:
        table = np.zeros(256, bool)
        table[list(marks)] = True
        columns.append(share(table[buf], offsets, size))
    lines = share(buf == 10, offsets, np.ones(len(size))) + 1
    doc = np.repeat(np.arange(len(counts)), counts)
    distinct = np.bincount(np.unique(doc * (len(ids) + 1) + ids) // (len(ids) + 1), minlength=len(counts))
    words = np.maximum(counts, 1)
    columns += [
        share(buf >= 128, offsets, size),
        share(ends - starts > 64, bounds, counts),
        dup_lines / lines,
        np.log1p(words / lines),
        repeated / words,
        covered / words,
        np.log1p(longest),
        distinct / words,
        (repeated / words) * columns[3 + CAPITALS],
        np.sqrt(symbols / words),
        np.sqrt(columns[4]),
        np.sqrt(repeated / words),
        np.log1p(np.maximum(0, 50 - counts)),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


@dataclass
class Bucket:
    """Vectors of preferred and rejected texts that are paired; the first ``own`` of each are no copies."""

    good: np.ndarray
    bad: np.ndarray
    own: tuple[int, int]

    def owned(self) -> np.ndarray:
        return np.concatenate([self.good[: self.own[0]], self.bad[: self.own[1]]])

    def differences(self, vectors: Callable[[np.ndarray], np.ndarray], pairs: int) -> np.ndarray:
        """Differences of distinct pairs, as many as asked for, but every text is in one."""
        g, b = len(self.good), len(self.bad)
        if not g or not b:
            return np.zeros((0, self.good.shape[1]))
        k = np.arange(min(max(pairs, g, b), g * b))
        return vectors(self.good)[k % g] - vectors(self.bad)[(k + k // math.lcm(g, b)) % b]


#: Sums over all buckets of the whole numbers that a function gives for each of them.
Sums = Callable[[Callable[[Bucket], np.ndarray]], list[int]]

# Fractions of the whole numbers.
MOMENT, SLOPE = 1 << 40, 1 << 24


def _moments(bucket: Bucket) -> np.ndarray:
    x = bucket.owned()
    return np.array([len(x), *[int(v * MOMENT) for v in (*x.sum(0).tolist(), *(x * x).sum(0).tolist())]], object)


def _scale(sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every measure."""
    n, half = sums[0], len(sums) // 2
    first, second = sums[1 : half + 1], sums[half + 1 :]
    mean = np.array([v / (n * MOMENT) for v in first])
    variance = np.array([(q * n * MOMENT - v * v) / (n * n * MOMENT * MOMENT) for v, q in zip(first, second)])
    return mean, np.sqrt(np.maximum(variance, 0)) + 1e-9


def _nothing() -> Ranking:
    n = vectors(pa.array([""])).shape[1]
    return Ranking(np.zeros(n), np.ones(n), np.zeros(n), np.array([0.0]), np.array([1.0]))


def _weights(sums: Sums, ranking: Ranking, rule: Training) -> np.ndarray:
    """Bradley-Terry weights by Newton steps over the pairs of all buckets."""
    size = len(ranking.mean)
    weights = np.zeros(size)
    for _ in range(rule.steps):

        def slope(bucket: Bucket, weights: np.ndarray = weights) -> np.ndarray:
            difference = bucket.differences(ranking.scaled, rule.pairs)
            p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
            gradient = difference.T @ (p - 1)
            curve = (difference * (p * (1 - p))[:, None]).T @ difference
            return np.rint(np.concatenate([[len(p)], gradient, curve.ravel()]) * SLOPE).astype(np.int64)

        found = np.array([v / SLOPE for v in sums(slope)])
        gradient = found[1 : size + 1] / found[0] + rule.ridge * weights
        curve = found[size + 1 :].reshape(size, size) / found[0]
        step = np.linalg.solve(curve + rule.ridge * np.eye(size), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _placed(sums: Sums, ranking: Ranking, rule: Training) -> Ranking:
    """The ranking with its places: the threshold lies where it separates the labels of all texts best."""
    bound = 8 * float(np.abs(ranking.weights).sum()) + 1e-9

    def counted(low: float, high: float) -> np.ndarray:
        """Texts of both labels in equal steps from low to high; texts outside are in the first or last."""

        def count(bucket: Bucket) -> np.ndarray:
            found = []
            for x in (bucket.bad[: bucket.own[1]], bucket.good[: bucket.own[0]]):
                step = (ranking.raw(x) - low) * (rule.places / (high - low))
                found.append(np.bincount(np.clip(step, 0, rule.places - 1).astype(np.int64), minlength=rule.places))
            return np.concatenate(found)

        return np.array(sums(count), np.int64).reshape(2, rule.places)

    # First between the bounds that no score passes, then between the lowest and the highest score.
    low, high = -bound, bound
    used = np.flatnonzero(counted(low, high).any(0))
    width = (high - low) / rule.places
    low, high = low + used[0] * width, low + (used[-1] + 1) * width
    bad, good = counted(low, high)
    width = (high - low) / rule.places
    used = np.flatnonzero(bad + good)
    if len(used) < 2:
        return Ranking(ranking.mean, ranking.scale, np.zeros(len(ranking.mean)), np.array([0.0]), np.array([1.0]))
    bad, good = bad[used], good[used]
    middle = low + (used + 0.5) * width
    # Texts below the cut that are rejected, and above it that are preferred.
    right = np.cumsum(bad)[:-1] + good.sum() - np.cumsum(good)[:-1]
    best = np.flatnonzero(right == right.max())
    cut = int(best[len(best) // 2]) + 1
    at = (middle[cut - 1] + middle[cut]) / 2

    # Places of a bounded number of quantiles on both sides of the cut.
    def quantiles(part: slice) -> np.ndarray:
        up_to = np.cumsum((bad + good)[part])
        return np.unique(middle[part][np.searchsorted(up_to, np.linspace(0, up_to[-1], 500))])

    below_cut, above_cut = quantiles(slice(0, cut)), quantiles(slice(cut, None))
    span = max(middle[-1] - middle[0], 1e-9)
    points = np.concatenate([[middle[0] - span], below_cut, [at], above_cut, [middle[-1] + span]])
    below = np.linspace(0, THRESHOLD, len(below_cut) + 1, endpoint=False)
    above = np.linspace(THRESHOLD, 1, len(above_cut) + 2)
    return Ranking(ranking.mean, ranking.scale, ranking.weights, points, np.concatenate([below, above]))


def _learned(sums: Sums, rule: Training) -> Ranking:
    mean, scale = _scale(sums(_moments))
    ranking = Ranking(mean, scale, np.zeros(len(mean)), np.array([0.0]), np.array([1.0]))
    ranking.weights = _weights(sums, ranking, rule)
    return _placed(sums, ranking, rule)


def learn(x: np.ndarray, label: np.ndarray, rule: Training) -> Ranking:
    """Bradley-Terry weights and the places of the labelled scores, from the vectors of one bucket."""
    if not len(x) or label.min() == label.max():
        return _nothing()
    good, bad = x[label == 1], x[label == 0]
    bucket = Bucket(good, bad, (len(good), len(bad)))
    return _learned(lambda count: count(bucket).tolist(), rule)


def measured(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``carry`` columns (all, if not given) with the measures of every text, as bytes, in ``vector``."""

    def measures(texts: pa.Array) -> list[pa.Array]:
        x = np.ascontiguousarray(vectors(texts))
        ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
        return [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])]

    return with_text_columns(df, lambda: measures, "vector binary", text, carry)


def _matrix(rows: pa.Array) -> np.ndarray:
    """Vectors out of their bytes."""
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(len(rows), -1)


def _buckets(rows: DataFrame, sizes: dict[int, int], rule: Training) -> DataFrame:
    """Rows (bucket, good, bad, own_good, own_bad): the vectors of every bucket, from rows (id, label, vector)."""
    n = rows_for(sum(sizes.values()), rule.texts)
    rare = min(sizes, key=sizes.get)
    # As many copies of the rarer label as give each bucket its mates; at most one for each bucket.
    copies = min(n, rows_for(rule.mates * n, sizes[rare]))
    times = F.when(F.col("label") == rare, F.lit(copies)).otherwise(F.lit(1))
    dealt = rows.select(
        "label", "vector", F.xxhash64("id").alias("key"), F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")
    )
    dealt = dealt.withColumn("bucket", F.pmod(F.pmod("key", F.lit(n)) + F.col("copy"), F.lit(n)))

    def gather(table: pa.Table) -> pa.Table:
        x, label = _matrix(table["vector"]), table["label"].to_numpy()
        copied = table["copy"].to_numpy() > 0
        order = np.lexsort((*x.T, table["key"].to_numpy(), copied))
        x, label, copied = x[order], label[order], copied[order]
        sides = [label == 1, label == 0]
        row = [table["bucket"][0].as_py(), *[x[side].tobytes() for side in sides], *[int((side & ~copied).sum()) for side in sides]]
        names = ["bucket", "good", "bad", "own_good", "own_bad"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({c: pa.array([v], t) for c, v, t in zip(names, row, types)})

    # A few buckets in a file, so that a batch of rows stays small.
    spread = dealt.repartition(rows_for(n, 8), "bucket").groupBy("bucket")
    return stage_compact(spread.applyInArrow(gather, "bucket bigint, good binary, bad binary, own_good bigint, own_bad bigint"), "buckets")


def _sums_over(buckets: DataFrame, size: int) -> Sums:
    """Sums that tasks make of their buckets, and Spark of those of the tasks."""

    def sums(count: Callable[[Bucket], np.ndarray]) -> list[int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                good, bad, own_good, own_bad = batch.columns
                for k in range(batch.num_rows):
                    sides = [np.frombuffer(side[k].as_py(), np.float64).reshape(-1, size) for side in (good, bad)]
                    part = count(Bucket(*sides, (own_good[k].as_py(), own_bad[k].as_py())))
                    total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total)
                values = pa.array([Decimal(int(v)) for v in total[at]], pa.decimal128(38, 0))
                out = [pa.array(at, pa.int64()), values, pa.array(np.full(len(at), len(total)), pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["place", "n", "size"])

        parts = buckets.select("good", "bad", "own_good", "own_bad").mapInArrow(run, "place bigint, n decimal(38,0), size bigint")
        # One row for a measure, a pair of measures, or a step of the scores.
        rows = parts.groupBy("place", "size").agg(F.sum("n").alias("n")).collect()
        out = [0] * rows[0]["size"]
        for row in rows:
            out[row["place"]] = int(row["n"])
        return out

    return sums


def fit(
    df: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    rule: Training = Training(),
) -> Ranking:
    """A ranking from all labelled rows for which ``learn_from`` holds."""
    return fit_measured(measured(df, text, [id_col]), labels, learn_from, id_col, label, rule)


def fit_measured(
    vectors_: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    label: str = "quality",
    rule: Training = Training(),
) -> Ranking:
    """The same from the result of ``measured``, best a written table; an id counts once for each of its labels."""
    ident = F.col(quoted(id_col))
    usable = labels.where(learn_from & F.col(quoted(label)).isin(0, 1) & ident.isNotNull())
    usable = usable.select(ident.alias("id"), F.col(quoted(label)).cast("int").alias("label")).distinct()
    rows = vectors_.select(ident.alias("id"), "vector").join(usable, "id")
    rows = stage_compact(rows.groupBy("id", "label").agg(F.min("vector").alias("vector")), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return _nothing()
    return _learned(_sums_over(_buckets(rows, sizes, rule), vectors(pa.array([""])).shape[1]), rule)


def rank_quality(
    df: DataFrame, ranking: Ranking, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """``carry`` columns (all, if not given) with the score and the predicted label of every text."""
    scored = with_text_columns(df, lambda: lambda t: [ranking.score(vectors(t))], "score double", text, carry)
    return _predicted(scored)


def rank_measured(vectors_: DataFrame, ranking: Ranking) -> DataFrame:
    """The same from the result of ``measured``."""
    carried = [f for f in vectors_.schema.fields if f.name != "vector"]
    out = StructType([*carried, StructField("score", DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = pa.array(ranking.score(_matrix(batch.column(len(carried)))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], score], schema=schema)

    kept = vectors_.select(*[F.col(quoted(f.name)) for f in carried], "vector")
    return _predicted(kept.mapInArrow(run, out))


def _predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a row without an id is one."""
    return (remainder(id_col, 5) == 0) | F.col(quoted(id_col)).isNull()
