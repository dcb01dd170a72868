"""Quality rules: repetition inside a text, found with a suffix array over its words.

The suffixes of all texts of a part are sorted together, text by text, by prefix doubling; only groups
that are still tied are sorted again. The longest common prefix of neighbouring suffixes gives, at every
word, the longest string of words from there that the text repeats. The spans of these are the spans of
the maximal repeated strings; their union is the covered share of the text.

Texts without a word (null, empty, white space) have zeros everywhere and fail the base rule. Rows are
judged one by one, so repeated rows get equal results, and no row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from counterfact.llm.batches import text_buffer, with_text_columns, word_bounds, word_ids

# Fixed values of the base rules: symbols, words of a window, least words, most repeated words in a hundred.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

COLUMNS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "kept": "boolean",
    "covered_words": "bigint",
    "longest_repeat": "bigint",
}


@dataclass(frozen=True)
class Limits:
    """Repeated strings count from ``min_repeat`` words on. A text is kept while they cover at most the
    share ``max_covered`` of its words, and the longest has at most ``max_longest`` words or, in a long text, the
    share ``long_share`` of its words."""

    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 100
    long_share: float = 0.1


def suffix_ranks(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, text by text, and the ranks after 1, 2, 4, ... words.

    Two suffixes have the same rank after 2^j words if and only if these words are equal. ``ends`` is, for
    every word, the number of the word after its text.
    """
    n = len(ids)
    at = np.arange(n, dtype=np.int64)
    key = doc * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = key[order]
    slots, groups = at, np.concatenate([[True], ordered[1:] != ordered[:-1]])
    levels, step = [], 1
    while True:
        firsts = slots[np.maximum.accumulate(np.where(groups, np.arange(len(slots)), 0))]
        rank[order[slots]] = firsts
        levels.append(rank.astype(np.int32) if n < 2**31 else rank.copy())
        last = np.concatenate([groups[1:], [True]])
        slots = slots[~(groups & last)]
        if not len(slots):
            return order, levels
        tied = order[slots]
        after = tied + step
        inside = after < ends[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        again = np.argsort(key, kind="stable")
        order[slots] = tied[again]
        key = key[again]
        groups = np.concatenate([[True], key[1:] != key[:-1]])
        step *= 2


def longest_repeats(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest string from there that the same text has elsewhere too."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, levels = suffix_ranks(ids, doc, ends)
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        lcp += np.where(inside & (levels[j][x] == levels[j][y]), 1 << j, 0)
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def _covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Whether a word is in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:n]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _maxima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[:-1][full])
    return out


def duplicate_lines(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    texts = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    stop = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    word = np.searchsorted(starts, begin)
    with_word = (word < len(starts)) & (starts[np.minimum(word, len(starts) - 1)] < stop) if len(starts) else begin < 0
    begin, stop = begin[with_word], stop[with_word]
    if not len(begin):
        return np.zeros(texts, np.int64)
    sizes = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(stop - begin, out=sizes[1:])
    change = np.zeros(len(buf) + 1, np.int8)
    change[begin] += 1
    change[stop] -= 1
    compact = buf[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    lines = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(sizes), pa.py_buffer(compact)])
    ids = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    distinct = np.unique(doc * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1)
    return np.bincount(doc, minlength=texts) - np.bincount(distinct, minlength=texts)


def measure(texts: pa.Array, limits: Limits) -> list[np.ndarray]:
    """All columns of the operator for an array of texts."""
    buf, offsets = text_buffer(texts)
    starts, stops, bounds = word_bounds(buf, offsets)
    counts = np.diff(bounds)
    n = len(starts)
    first_bytes = np.zeros(256, bool)
    first_bytes[[*range(0, 128), *range(192, 256)]] = True
    first_bytes[[9, 10, 11, 12, 13, 32]] = False
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    ids, _ = word_ids(buf, starts, stops)
    doc = np.repeat(np.arange(len(counts)), counts)
    longest = longest_repeats(ids, doc, np.repeat(bounds[1:], counts))
    windows = np.flatnonzero(longest >= WINDOW)
    repeated = _sums(_covered(windows, np.full(len(windows), WINDOW), n), bounds)
    spans = np.flatnonzero(longest >= limits.min_repeat)
    covered = _sums(_covered(spans, longest[spans], n), bounds)
    most = _maxima(longest, bounds)
    failed = (counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * counts)
    allowed = np.maximum(limits.max_longest, limits.long_share * counts)
    kept = ~failed & (covered <= limits.max_covered * counts) & (most <= allowed)
    return [
        counts,
        _sums(first_bytes[buf], offsets),
        _sums(symbols[buf], offsets),
        duplicate_lines(buf, offsets, starts),
        repeated,
        failed,
        kept,
        covered,
        most,
    ]


def quality_rules(
    df: DataFrame, text: str = "text", limits: Limits = Limits(), carry: Sequence[str] | None = None, prefix: str = ""
) -> DataFrame:
    """The ``carry`` columns of every row (all, if not given) with the measures and verdicts of its text.

    A carried column with the name of a measure gives way to it; ``prefix`` is set before the measures' names.
    A row is judged where it lies; nothing is shuffled. Memory follows one part of a batch, or the longest
    text.
    """
    columns = ", ".join(f"`{prefix}{name}` {kind}" for name, kind in COLUMNS.items())
    return with_text_columns(df, lambda: lambda texts: measure(texts, limits), columns, text, carry)
