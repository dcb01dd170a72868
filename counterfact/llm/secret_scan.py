"""Secret scan with ownership over the whole corpus.

Every text is searched for candidates. The digest of a candidate's value is counted by the distinct owners of
the distinct texts that hold it: a value that many owners hold is a widely copied example, one that a single
owner holds looks like a live credential, in however many documents. A text that several owners hold is one
text of one owner, so exact copies of a document do not take a value from its owner. Base candidates are
always reported; generic candidates (long mixed strings) are reported when they look live.

Only digests and owners are shuffled, never values or texts. A value that very many documents hold is reduced
on the map side, first by (value, owner, text).

Defined cases: a null or empty text has no candidates; a null owner counts as one unknown owner; repeated rows are reported one by one and counted once as owners; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfact.llm.batches import quoted, text_buffer, with_text_columns
from counterfact.llm.staging import stage

# Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "generic")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Access and hex candidates, and generic ones, lie inside runs of these bytes of so many at least.
RUN_BYTES = np.zeros(256, bool)
RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")] = True
RUN = 16


@dataclass(frozen=True)
class Ownership:
    """A value is widely copied when it has more than ``max_others`` owners beside the leading one, and this one
    does not stand out: it holds less of the value's texts than half way from its share of all rows to all. Any
    other value looks live."""

    max_others: int = 1
    least_generic: int = 24
    least_digits: int = 4
    least_letters: int = 4
    least_entropy: float = 3.5


def entropy(value: str) -> float:
    """Bits of a character of the value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _assigned(text: str) -> list[tuple[int, int, int, str]]:
    if ":" not in text and "=" not in text:
        return []
    low = text.lower()
    if not any(w in low for w in WORDS_OF_ASSIGN):
        return []
    return [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]


def _in_run(run: str, at: int, rule: Ownership) -> list[tuple[int, int, int, str]]:
    found = [(at + m.start(), 1, at + m.end(), m.group()) for m in ACCESS.finditer(run) if len(m.group()) >= LEAST_ACCESS]
    found += [(at + m.start(), 2, at + m.end(), m.group()) for m in HEX.finditer(run)]
    digits = sum(c.isdigit() for c in run)
    letters = sum(c.isalpha() for c in run)
    if (
        len(run) >= rule.least_generic
        and digits >= rule.least_digits
        and letters >= rule.least_letters
        and entropy(run) >= rule.least_entropy
    ):
        found.append((at, 3, at + len(run), run))
    return found


def candidates(texts: pa.Array, rule: Ownership) -> list[list[tuple[int, int, int, str]]]:
    """Candidates (start, kind, end, value) of every text, in code points, by start, then kind.

    Generic candidates that touch a base candidate are left out.
    """
    buf, offsets = text_buffer(texts)
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.take(RUN_BYTES, buf, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    # A run may cross the border of two texts; it is cut there.
    cut = offsets[1:-1][inside[offsets[1:-1]] & inside[offsets[1:-1] + 1]] if len(offsets) > 2 else offsets[:0]
    cut = np.unique(cut)
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= RUN
    starts, ends = starts[long], ends[long]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    runs: dict[int, list[tuple[int, int]]] = {}
    for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist()):
        runs.setdefault(d, []).append((s, e))
    data = buf.tobytes()
    found = []
    for d, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if begin == stop:
            found.append([])
            continue
        here = _assigned(data[begin:stop].decode()) if _may_assign(data, begin, stop) else []
        at, before = begin, 0
        for s, e in runs.get(d, ()):
            piece = _in_run(data[s:e].decode(), 0, rule)
            if piece:
                before += len(data[at:s].decode())
                at = s
                here += [(x + before, k, y + before, v) for x, k, y, v in piece]
        base = [(x, y) for x, k, y, _ in here if k < 3]
        found.append(sorted(c for c in here if c[1] < 3 or not any(c[0] < y and x < c[2] for x, y in base)))
    return found


def _may_assign(data: bytes, begin: int, stop: int) -> bool:
    return data.find(b"=", begin, stop) >= 0 or data.find(b":", begin, stop) >= 0


def written(spans: list[tuple[int, int, int]]) -> str:
    """Spans (start, kind, end) as text."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _columns(texts: pa.Array, rule: Ownership) -> list:
    counts = [[], [], []]
    digests, found, whole = [], [], []
    for here, text in zip(candidates(texts, rule), texts):
        base = [(s, k, e) for s, k, e, _ in here if k < 3]
        for kind in range(3):
            counts[kind].append(sum(k == kind for _, k, _ in base))
        digests.append(hashlib.sha256(written(base).encode()).hexdigest())
        found.append(
            [
                {"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).digest()}
                for s, k, e, v in here
            ]
        )
        whole.append(hashlib.sha256(text.as_py().encode()).digest() if here else None)
    return [*counts, digests, found, whole]


FOUND = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "found array<struct<start: bigint, kind: int, end: bigint, value: binary>>, "
    "text_sha256 binary"
)


def ownership(found: DataFrame, sizes: DataFrame, rule: Ownership) -> DataFrame:
    """Rows (value, n_owners, live) from rows (value, owner, text) and the share of every owner in all rows.

    An owner that holds all the texts of a value is its only one; else a text counts for its least owner. The
    leading owner is the one with most of the texts.
    """
    once = found.select("value", "owner", "text").distinct()
    per_owner = once.groupBy("value", "owner").agg(F.count("*").alias("n"))
    lead = per_owner.groupBy("value").agg(F.max(F.struct("n", "owner")).alias("lead")).select("value", "lead.*")
    by_text = once.groupBy("value", "text").agg(F.min("owner").alias("owner"))
    by_owner = by_text.groupBy("value", "owner").agg(F.count("*").alias("n"))
    totals = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_texts"))
    held = totals.join(lead, "value").join(sizes, "owner")
    n_owners = F.when(F.col("n") == F.col("n_texts"), 1).otherwise(F.col("n_owners"))
    stands_out = F.col("n") / F.col("n_texts") >= (1 + F.col("share")) / 2
    return held.select("value", n_owners.alias("n_owners"), ((n_owners <= 1 + rule.max_others) | stands_out).alias("live"))


def secret_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    rule: Ownership = Ownership(),
) -> DataFrame:
    """Rows (id, counts of the base kinds, digest of the base spans, all spans, n_live, n_copied) for every row.

    ``n_live`` counts the candidates that look live, ``n_copied`` the base candidates that are widely copied.
    """
    inputs = df.select(
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("")).alias("owner"),
        F.col(quoted(text)).alias("text"),
    )
    scanned = with_text_columns(
        inputs, lambda: lambda texts: _columns(texts, rule), FOUND, carry=["id", "owner"]
    )
    # The number of a row is fixed by writing it.
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = scanned.where(F.size("found") > 0).select("row", "owner", F.col("text_sha256").alias("text"), F.inline("found"))
    rows = scanned.agg(F.count("*")).first()[0] or 1
    sizes = scanned.groupBy("owner").agg((F.count("*") / rows).alias("share"))
    judged = each.join(ownership(each, sizes, rule), "value")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, k)])
    spans = F.array_sort(
        F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end")))
    )
    by_row = judged.groupBy("row").agg(
        spans.alias("kept"),
        F.count_if("live").alias("n_live"),
        F.count_if((F.col("kind") < 3) & ~F.col("live")).alias("n_copied"),
    )
    text_of = F.concat_ws(
        ",", F.transform("kept", lambda s: F.concat_ws(":", order[s["kind"]], s["start"], s["end"]))
    )
    return scanned.join(by_row, "row", "left").select(
        F.col("id").alias(id_col),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(text_of, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
