"""User functions over batches of columns, and pluggable scorers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from counterfact import fixed

Columns = dict[str, pa.Array]
# From masked lines, targets, opposites, and evidence if it is asked for, to the probabilities of both words.
Scorer = Callable[..., tuple[Sequence, Sequence]]


def map_batches(
    df: DataFrame, fn: Callable[[Columns], Columns], schema: str | StructType, batch_rows: int = fixed.MAP_BATCH_ROWS
) -> DataFrame:
    """Apply ``fn`` to batches of columns; it may change the number of rows.

    Columns go in and come out as Arrow arrays. The output holds the columns of ``schema`` only. A batch
    ends at the end of a partition, so ``fn`` must not depend on which rows share one.
    """
    out_type = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                columns = fn(dict(zip(part.schema.names, part.columns)))
                yield pa.RecordBatch.from_arrays(
                    [columns[f.name].cast(f.type) for f in arrow_schema], schema=arrow_schema
                )

    return df.mapInArrow(run, out_type)


def masked_scorer(
    hits: DataFrame,
    make_scorer: Callable[[], Scorer],
    keys: Sequence[str] = ("doc_id", "line_no"),
    rows: int = 256,
    evidence: Sequence[str] = (),
) -> DataFrame:
    """Score masked lines with a scorer of the caller.

    The scorer is made once per task and called with many lines at a time: masked lines, targets,
    opposites. It returns the two probabilities of every line, None where it cannot score one; such
    rows are kept with NULL, so that they can be counted. ``evidence`` names further columns, such as those of
    ``cloze.item_evidence``; the scorer gets them as a fourth argument, a dictionary of lists.
    """
    inputs = hits.select(*keys, "masked", "target", "opposite", *evidence)
    fields = [inputs.schema[c] for c in (*keys, "target", "opposite")]
    out_type = StructType(fields).add("p1", "double").add("p2", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            for start in range(0, len(frame), rows):
                part = frame.iloc[start : start + rows]
                seen = [{c: list(part[c]) for c in evidence}] if evidence else []
                p1, p2 = scorer(list(part["masked"]), list(part["target"]), list(part["opposite"]), *seen)
                out = part[[*keys, "target", "opposite"]].copy()
                out["p1"] = pd.Series(list(p1), index=out.index, dtype="float64")
                out["p2"] = pd.Series(list(p2), index=out.index, dtype="float64")
                yield out

    return inputs.mapInPandas(run, out_type).select(
        *keys, "target", "opposite", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("p1", "p2")]
    )


def count_scorer(n_env: int, alpha: float, vocab_size: int) -> Callable[[], Scorer]:
    """Scorer with the mean of the environments' estimators, from the evidence of ``cloze.item_evidence``.

    Made of closures, which reach the tasks by value.
    """

    def make_scorer() -> Scorer:
        unseen = math.log(alpha)

        def mean(counts) -> float:
            """Mean over the environments of ``ln(n + alpha)``; most have not seen the word."""
            found = [] if counts is None else counts
            return unseen + sum(math.log(n + alpha) - unseen for n in found if n) / n_env

        def score(masked, targets, opposites, seen):
            sums, n_seen = seen["seen_sum"], seen["n_seen"]
            z = [math.log((s or 0.0) + (vocab_size - (n or 0)) * alpha) for s, n in zip(_plain(sums), _plain(n_seen))]
            return tuple([math.exp(mean(n) - t) for n, t in zip(seen[c], z)] for c in ("n_target", "n_opposite"))

        def _plain(values):
            return [None if v is None or v != v else v for v in values]

        return score

    return make_scorer


def place_scorer(
    counts: dict[tuple[str, bool], int], terms: Sequence[str], alpha: float, mask: str = fixed.MASK
) -> Callable[[], Scorer]:
    """Scorer that reads the masked line: the share of a term among all terms, at the beginning of a line if
    no word stands before the mask, and inside a line otherwise.

    ``counts`` has the frequencies of the terms in both places, twice as many as terms at most. The scorer is
    made of closures, which reach the tasks by value, without this package on their path.
    """
    shares = {}
    for first in (True, False):
        total = sum(counts.get((t, first), 0) for t in terms) + alpha * len(terms)
        shares |= {(t, first): (counts.get((t, first), 0) + alpha) / total for t in terms}
    word = re.compile(r"\w")

    def make_scorer() -> Scorer:
        def score(masked, targets, opposites):
            first = [word.search(line[: line.index(mask)]) is None for line in masked]
            return (
                [shares.get((t, f)) for t, f in zip(targets, first)],
                [shares.get((o, f)) for o, f in zip(opposites, first)],
            )

        return score

    return make_scorer
