"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is an n-gram of words of a test item that is rare: the product of the rates of its words in the corpus
is small. A training text that holds a seed has a passage around it that may be a copy of the item; passage
and item are aligned word by word, and the passage counts as a copy when the best local alignment has at least
a given share of the score of a perfect one. Edited and paraphrased copies keep some seeds and much of the
alignment. Rarity is judged by the words and not by the n-gram, so an item that was copied very often keeps its
seeds. An item whose seeds are all common keeps its rarest ones.

The items are a stated set of queries. They are taken in blocks of a bounded size, each sent to all tasks and
met with every text of the corpus; texts are not shuffled, and no pairs are made but those with a seed.

Scripts that are written without blanks (Chinese, Japanese, Thai, Lao, Burmese, Khmer) are taken apart into
characters, each a word. An item of fewer than ``min_words`` words cannot be told from chance by a part of it: only
its whole sequence of words is a copy, and of an item of fewer words than a seed, only a text that is nothing else.
Every copy in a text is reported, and copies of one item do not overlap.

Defined cases: null or empty texts and items match nothing; items of one text are matched once and reported one by
one; repeated rows are reported one by one; with an empty corpus or no items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructType

from counterfact.llm.batches import LOWER, free_name, quoted, text_buffer, with_text_columns, word_bounds, word_ids
from counterfact.llm.staging import stage

#: Words are runs of ASCII letters, digits and bytes of other letters.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


# First and last characters of scripts that are written without blanks, as UTF-8 of three bytes.
UNSPACED = (
    (0xE0B880, 0xE0BBBF),  # Thai, Lao
    (0xE18080, 0xE1829F),  # Burmese
    (0xE19E80, 0xE19FBF),  # Khmer
    (0xE38180, 0xE383BF),  # Japanese syllables
    (0xE39080, 0xE9BFBF),  # Chinese characters
    (0xEFA480, 0xEFABBF),  # Chinese characters, compatibility
)
#: First bytes, and the least second byte, of Chinese characters of four bytes.
RARE_LEAD, RARE_SECOND = 0xF0, 0xA0

#: Numbers of the tables of an alignment at a time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Rule:
    """``seed`` words of a seed; the rate below which it is rare; seeds that an item keeps at least; the share
    of the perfect score of a copy; scores of a match, a mismatch and a gap; words of the shortest item that a
    part tells; bytes of the items of a block."""

    seed: int = 3
    rate: float = 1e-7
    least_seeds: int = 4
    share: float = 0.4
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    min_words: int = 8
    block_bytes: int = 4 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the distinct words, these, and each text's first word."""
    buf, offsets = text_buffer(texts)
    buf = LOWER[buf]
    starts, ends, firsts = word_bounds(buf, offsets, GAP)
    cuts = _unspaced(buf)
    if len(cuts):
        # Only borders inside a word are new.
        word = np.searchsorted(starts, cuts, side="right") - 1
        cuts = cuts[(word >= 0) & (starts[word] < cuts) & (cuts < ends[word])]
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        firsts = np.searchsorted(starts, offsets)
    ids, distinct = word_ids(buf, starts, ends, GAP)
    return ids, distinct, firsts


def _unspaced(buf: np.ndarray) -> np.ndarray:
    """Borders of the characters that are words of their own."""
    lead = np.flatnonzero(buf >= 0xE0)
    lead = lead[lead + 2 < len(buf)]
    if not len(lead):
        return lead
    three = (buf[lead].astype(np.int64) << 16) | (buf[lead + 1].astype(np.int64) << 8) | buf[lead + 2]
    alone = np.zeros(len(lead), bool)
    for first, last in UNSPACED:
        alone |= (three >= first) & (three <= last)
    rare = (buf[lead] == RARE_LEAD) & (buf[lead + 1] >= RARE_SECOND)
    return np.unique(np.concatenate([lead[alone], lead[alone] + 3, lead[rare], lead[rare] + 4]))


class Items:
    """A block of test items: their words as numbers of a vocabulary, and their seeds."""

    def __init__(self, names: Sequence, texts: Sequence[str], rule: Rule):
        self.rule = rule
        ids, distinct, firsts = _words(pa.array(texts, pa.string()))
        sizes = np.diff(firsts)
        some = np.flatnonzero(sizes > 0)
        self.names = [names[k] for k in some]
        self.words = [ids[firsts[k] : firsts[k + 1]] for k in some]
        self.sizes = sizes[some]
        # Score that a copy needs.
        share = np.where(self.sizes < rule.min_words, 1.0, rule.share)
        self.needed = share * rule.match * self.sizes
        # Items that are too short for a seed, by their words.
        self.tiny: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(self.sizes < rule.seed).tolist():
            self.tiny.setdefault(tuple(self.words[k].tolist()), []).append(k)
        self.vocabulary = distinct
        self.base = len(distinct) + 1
        if self.base**rule.seed >= 2**63:
            raise ValueError("a block of items has too many words for its seeds; take smaller blocks")

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of the texts as numbers of the vocabulary, -1 for others, and each text's first word."""
        ids, distinct, firsts = _words(texts)
        known = pc.index_in(distinct, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        return known[ids] if len(ids) else np.zeros(0, np.int64), firsts

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Key of the n-gram that begins at each word but the last ones."""
        n = self.rule.seed
        out = np.zeros(max(0, len(words) - n + 1), np.int64)
        for k in range(n):
            out = out * self.base + words[k : k + len(out)]
        return out

    def choose_seeds(self, rates: np.ndarray) -> None:
        """Keep the rare n-grams of each item, with the item and the place in it, sorted by key."""
        logs = np.log(rates)
        found = []
        for item, words in enumerate(self.words):
            keys = self.keys(words)
            weight = sum(logs[words[k : k + len(keys)]] for k in range(self.rule.seed))
            rare = weight <= np.log(self.rule.rate)
            if rare.sum() < self.rule.least_seeds:
                rare = np.zeros(len(keys), bool)
                rare[np.argsort(weight, kind="stable")[: self.rule.least_seeds]] = True
            at = np.flatnonzero(rare)
            found.append(np.stack([keys[at], np.full(len(at), item), at]))
        seeds = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        self.seeds = seeds[:, np.argsort(seeds[0], kind="stable")]


def align(passages: np.ndarray, items: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each passage with its item (both padded with -1 and -2), and where it ends."""
    rows, width = passages.shape
    slope = -rule.gap * np.arange(width + 1)
    above = np.zeros((rows, width + 1), np.int64)
    best, place = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(items.shape[1]):
        word = items[:, k : k + 1]
        step = np.where(passages == word, rule.match, rule.mismatch)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(above[:, :-1] + step, above[:, 1:] + rule.gap)
        np.maximum(here, 0, out=here)
        # Gaps along the passage: the best of all places before, less what the way from there costs.
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here = np.where(word == -2, 0, here)
        at = here.argmax(1)
        top = here[np.arange(rows), at]
        better = top > best
        best, place = np.where(better, top, best), np.where(better, at, place)
        above = here
    return best, place


def _padded(pieces: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(pieces), max(map(len, pieces))), fill, np.int64)
    for row, piece in zip(out, pieces):
        row[: len(piece)] = piece
    return out


def matches(texts: pa.Array, items: Items) -> list[list[dict]]:
    """Copies of items in every text: item, score, first word and the word after the last."""
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    numbers, firsts = items.numbers(texts)

    def report(doc: int, item: int, score: float, first: int, end: int) -> None:
        place = {"first_word": int(first - firsts[doc]), "end_word": int(end - firsts[doc])}
        found[doc].append({"item_id": items.names[item], "score": float(score), **place})

    if items.tiny:
        size = np.diff(firsts)
        for doc in np.flatnonzero((size > 0) & (size < items.rule.seed)).tolist():
            for item in items.tiny.get(tuple(numbers[firsts[doc] : firsts[doc + 1]].tolist()), ()):
                report(doc, item, 1.0, firsts[doc], firsts[doc + 1])
    doc, item, start, stop = _passages(numbers, firsts, items)
    copies = []
    while len(doc):
        best, first, end = _aligned(numbers, item, start, stop, items)
        hit = best >= items.needed[item]
        copies.append(np.stack([doc[hit], item[hit], first[hit], end[hit]]))
        score = best[hit] / (items.rule.match * items.sizes[item[hit]])
        for k, s in zip(np.flatnonzero(hit).tolist(), score.tolist()):
            report(doc[k], item[k], s, first[k], end[k])
        # What lies before and after a copy may hold another one.
        doc, item = np.tile(doc[hit], 2), np.tile(item[hit], 2)
        start, stop = np.append(start[hit], end[hit]), np.append(first[hit], stop[hit])
        room = (stop - start) * items.rule.match >= items.needed[item]
        doc, item, start, stop = doc[room], item[room], start[room], stop[room]
    return [_apart(here) for here in found]


def _apart(copies: list[dict]) -> list[dict]:
    """Copies by item and place; of those of one item that overlap, which two passages may both hold, the best."""
    kept: dict = {}
    for c in sorted(copies, key=lambda c: (-c["score"], c["first_word"])):
        same = kept.setdefault(c["item_id"], [])
        if all(c["end_word"] <= k["first_word"] or k["end_word"] <= c["first_word"] for k in same):
            same.append(c)
    return [c for same in kept.values() for c in sorted(same, key=lambda c: c["first_word"])]


def _passages(numbers: np.ndarray, firsts: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Text, item, first word and end of the passages around seeds."""
    none = (np.zeros(0, np.int64),) * 4
    keys = items.keys(numbers)
    if not len(keys) or not items.seeds.shape[1]:
        return none
    n = items.rule.seed
    whole = np.ones(len(keys), bool)
    for k in range(n):
        whole &= numbers[k : k + len(keys)] >= 0
    at = np.flatnonzero(whole)
    doc = np.searchsorted(firsts, at, side="right") - 1
    inside = at + n <= firsts[doc + 1]
    at, doc = at[inside], doc[inside]
    lo = np.searchsorted(items.seeds[0], keys[at], side="left")
    hi = np.searchsorted(items.seeds[0], keys[at], side="right")
    times = hi - lo
    which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, doc = np.repeat(at, times), np.repeat(doc, times)
    item, offset = items.seeds[1][which], items.seeds[2][which]
    begin = at - offset  # where the item would begin
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    if not len(doc):
        return none
    # Seeds of one copy begin near each other; a gap of more than half the item starts another passage.
    new = np.ones(len(doc), bool)
    far = begin[1:] - begin[:-1] > items.sizes[item[1:]] // 2 + 1
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | far
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc, item = doc[first], item[first]
    size = items.sizes[item]
    start = np.maximum(begin[first] - size // 2, firsts[doc])
    stop = np.minimum(begin[last] + size + size // 2 + 1, firsts[doc + 1])
    return doc, item, start, stop


def _aligned(
    numbers: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray, items: Items
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score of every passage with its item, and the words where it begins and ends.

    Passages of about one length are aligned together, as many as make a table of ``CELLS`` numbers.
    """
    width = stop - start
    scores, first, end = np.zeros(len(item)), start.copy(), start.copy()
    order = np.lexsort((items.sizes[item], width))
    at = 0
    while at < len(order):
        rows = max(1, min(256, CELLS // max(1, int(width[order[at]]))))
        while rows > 1 and rows * int(width[order[min(at + rows, len(order)) - 1]]) > CELLS:
            rows = rows // 2
        group = order[at : at + rows]
        at += rows
        passages = [numbers[start[g] : stop[g]] for g in group]
        wanted = [items.words[item[g]] for g in group]
        best, reach = align(_padded(passages, -1), _padded(wanted, -2), items.rule)
        scores[group] = best
        copies = np.flatnonzero(best >= items.needed[item[group]])
        if len(copies):
            # Backwards, the alignment ends where it begins.
            back = [passages[c][: reach[c]][::-1] for c in copies]
            _, length = align(_padded(back, -1), _padded([wanted[c][::-1] for c in copies], -2), items.rule)
            end[group[copies]] = start[group[copies]] + reach[copies]
            first[group[copies]] = end[group[copies]] - length
    return scores, first, end


def _rates(df: DataFrame, text: str, items: Items) -> np.ndarray:
    """Share of the corpus's words that each word of the items has; one word is added for unseen ones."""

    def count(texts: pa.Array) -> list:
        numbers, firsts = items.numbers(texts)
        counts = np.bincount(numbers[numbers >= 0], minlength=len(items.vocabulary))
        seen = np.flatnonzero(counts)
        rows: list[list] = [[] for _ in range(len(texts))]
        rows[0] = [{"word": int(w), "n": int(counts[w])} for w in seen] + [{"word": -1, "n": len(numbers)}]
        return [rows]

    out = "counts array<struct<word: bigint, n: bigint>>"
    each = with_text_columns(df, lambda: count, out, text, carry=[]).select(F.inline("counts"))
    # One row for a word of the block at most.
    total = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rates = np.array([total.get(w, 0) + 1 for w in range(len(items.vocabulary))], np.float64)
    return rates / (total.get(-1, 0) + len(rates) + 1)


def _text_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (id, text, key) of the items; the key is a digest of the text."""
    items = benchmark.select(F.col(quoted(item_id)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    return items.where("text is not null").withColumn("key", F.sha2("text", 256))


def item_blocks(items: DataFrame, name: str, rule: Rule) -> tuple[int, Iterator[Items]]:
    """Number of blocks, and the distinct texts of the items in blocks of about ``rule.block_bytes``, one at a time.

    A block is what is on the driver and in a task at once. A text is named by its key, or by its least id.
    """
    texts = items.groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("id"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-size // rule.block_bytes))
    number = F.pmod(F.xxhash64("key"), F.lit(count))

    def blocks() -> Iterator[Items]:
        for k in range(count):
            rows = texts.where(number == k).orderBy("key").collect()
            block = Items([r[name] for r in rows], [r["text"] for r in rows], rule)
            if block.words:
                yield block

    return count, blocks()


def _match_type(kind: DataType) -> ArrayType:
    each = StructType().add("item_id", kind).add("score", DoubleType())
    return ArrayType(each.add("first_word", LongType()).add("end_word", LongType()))


def _with_block(df: DataFrame, items: Items, text: str, carry: Sequence[str], column: str, kind: ArrayType) -> DataFrame:
    """``carry`` columns with the copies of the items of one block."""
    items.choose_seeds(_rates(df, text, items))
    out = StructType().add(column, kind)
    return with_text_columns(df, lambda: lambda texts: [matches(texts, items)], out, text, carry)


def with_matches(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rule: Rule = Rule(),
    column: str = "matches",
) -> DataFrame:
    """The columns of every row with the copies of items in its text.

    ``column`` is an array of (item_id, score, first_word, end_word), empty for a clean text; items of one text
    are named by their least id. If the table has a column of that name, the new one gets a free name like it. With
    more than one block of items, the table is written after each, so that a task holds one block.
    """
    kind = _match_type(benchmark.schema[item_id].dataType)
    column = free_name(df, column)
    count, blocks = item_blocks(_text_items(benchmark, item_id, item_text), "id", rule)
    found, part = free_name(df, "_found"), free_name(df, "_part")
    made = df.select(*map(quoted, df.columns), F.array().cast(kind).alias(found))
    for items in blocks:
        each = _with_block(made, items, text, [*df.columns, found], part, kind)
        made = each.select(*map(quoted, df.columns), F.concat(quoted(found), quoted(part)).alias(found))
        if count > 1:
            made = stage(made, "matches")
    return made.withColumnRenamed(found, column)


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", rule: Rule = Rule()
) -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word) for every copy of an item in a row of ``df``."""
    kind = _match_type(StringType())
    listed = _text_items(benchmark, "item_id", "text")
    count, blocks = item_blocks(listed, "key", rule)
    result = None
    for items in blocks:
        each = _with_block(df, items, text, [id_col], free_name(df, "_found"), kind)
        rows = each.select(F.col(quoted(id_col)).alias("_doc"), F.inline(quoted(each.columns[-1])))
        rows = stage(rows, "copies") if count > 1 else rows
        result = rows if result is None else result.union(rows)
    if result is None:
        out = StructType().add(id_col, df.schema[id_col].dataType).add("item_id", benchmark.schema["item_id"].dataType)
        out = out.add("score", DoubleType()).add("first_word", LongType()).add("end_word", LongType())
        return df.sparkSession.createDataFrame([], out)
    named = result.withColumnRenamed("item_id", "key").join(listed.select("key", F.col("id").alias("_item")), "key")
    return named.select(
        F.col("_doc").alias(id_col), F.col("_item").alias("item_id"), "score", "first_word", "end_word"
    )
