"""BPE as an automaton over tokens, compiled from the merges one gadget at a time.

The automaton reads tokens; its state is the token read last, and an arc p -> x exists if and only if x may
stand after p in an encoding. At first every base symbol may follow every other. The merge u v -> w, taken in
order of rank, is a gadget: wherever u is entered and v may follow, an arc w is added beside u, the state of
w gets the arcs of v, and the arc v is taken out of the state of u. So the arcs into w are those into u, and
the arcs out of w those of v, both as they stood at that merge. The gadgets are kept as three tables (left
part, right part, rank) and the arcs that merges take out as a hash table; whether an arc exists follows by
going back gadget by gadget, without a table of all pairs of tokens.

The automaton is deterministic: of all tokens that end at a place of a word, exactly one continues the path
of the word's beginning. A word is encoded symbol by symbol, keeping that token for each place. Words are
worked on together, as arrays, and each distinct word of a part once. Decoding emits the labels of the arcs.

The token of a place depends on the tokens of the places before it that one token can span, and on nothing else.
So a very long word is cut into pieces that overlap and are worked on together, each as if the word began with it:
where the tokens of two pieces agree on as many places of their overlap as the longest token has symbols, they agree
from there on. A word whose pieces do not meet is encoded in one.

Defined cases: a null or empty text has no tokens and decodes to an empty text; rows are encoded one by one.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from counterfact.llm.batches import text_buffer, with_text_columns, word_bounds, word_ids

# Fixed values of the word tokenizer: its white space, and the contractions that it splits off.
WHITE_SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges() -> dict[str, str]:
    """For each category, or its first letter, its characters as ranges of a pattern's class."""
    out: dict[str, str] = {}
    kinds = map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))
    at = 0
    for kind, run in itertools.groupby(kinds):
        first, at = at, at + sum(1 for _ in run)
        for name in (kind, kind[0]):
            out[name] = out.get(name, "") + f"\\U{first:08x}-\\U{at - 1:08x}"
    return out


_RANGES = _ranges()
LETTERS, NUMBERS = _RANGES["L"], _RANGES["N"]
SPLIT = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE_SPACE}{LETTERS}{NUMBERS}]+")
ASCII_SPLIT = re.compile(f"{CONTRACTIONS}|[a-z]+|[0-9]|[^{WHITE_SPACE}a-z0-9]+")
#: Characters that this Python does not know; newer tables may class them otherwise.
NOT_KNOWN = re.compile(f"[{_RANGES['Cn']}]")
WORD_END = "</w>"

#: Bytes of text of a part: each distinct word of a part is encoded once, so larger parts are cheaper.
PART_BYTES = 8 << 20

#: Symbols of a piece of a long word, and of its overlap with the piece before.
PIECE, OVERLAP = 4_096, 1_024


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [of[b] for b in range(256)]


class Lookup:
    """Hash table from 64-bit keys to numbers, looked up for whole arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.last = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


@dataclass
class Automaton:
    """Tables of the automaton; ``symbols`` is the size of its alphabet."""

    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    merges: Lookup
    arcs: Lookup
    token_at: np.ndarray
    labels: pa.Array
    specials: dict[str, int]
    longest: int
    symbols: int = 512

    def follows(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the state of token p has an arc x."""
        out = np.ones(len(p), bool)
        at = np.arange(len(p))
        p, x = p.astype(np.int64), x.astype(np.int64)
        # Twice the rank up to which merges have been applied, one more if that merge has.
        limit = np.full(len(p), 2**40)
        n = len(self.rank)
        while len(at):
            rule = self.merges.get(p * n + x).astype(np.int64)
            gone = (rule >= 0) & (2 * rule < limit)
            out[at[gone]] = False
            rp, rx = self.rank[p], self.rank[x]
            more = ~gone & ((rp >= 0) | (rx >= 0))
            at, p, x, rp, rx = at[more], p[more], x[more], rp[more], rx[more]
            into = rx >= rp
            limit = np.where(into, 2 * rx + 1, 2 * rp)
            p, x = np.where(into, p, self.right[p]), np.where(into, self.left[x], x)
        return out

    def encode(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as symbols, word after word, and the number of each word's first token."""
        long = np.flatnonzero(np.diff(bounds) > PIECE + OVERLAP)
        if not len(long):
            return self._read(*self._paths(symbols, bounds), bounds)
        # Long words are empty ones here, and what they hold is put between the others.
        sizes = np.diff(bounds)
        inside = np.repeat(sizes <= PIECE + OVERLAP, sizes)
        sizes[long] = 0
        short = np.zeros(len(bounds), np.int64)
        np.cumsum(sizes, out=short[1:])
        tokens, firsts = self._read(*self._paths(symbols[inside], short), short)
        counts, apart = np.diff(firsts), {}
        for w in long.tolist():
            apart[w] = self._long_word(symbols[bounds[w] : bounds[w + 1]])
            counts[w] = len(apart[w])
        np.cumsum(counts, out=firsts[1:])
        out, plain = np.zeros(int(firsts[-1]), np.int64), np.ones(int(firsts[-1]), bool)
        for w, found in apart.items():
            out[firsts[w] : firsts[w + 1]] = found
            plain[firsts[w] : firsts[w + 1]] = False
        out[plain] = tokens
        return out, firsts

    def _long_word(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of one long word."""
        token, start = (x.tolist() for x in self._long_path(symbols))
        out, place = [], len(symbols) - 1
        while place >= 0:
            out.append(token[place])
            place = start[place] - 1
        return np.array(out[::-1], np.int64)

    def _long_path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_paths`` for one long word."""
        n = len(symbols)
        cuts = np.arange(0, n, PIECE)
        firsts, ends = np.maximum(cuts - OVERLAP, 0), np.minimum(cuts + PIECE, n)
        bounds = np.zeros(len(cuts) + 1, np.int64)
        np.cumsum(ends - firsts, out=bounds[1:])
        spread = np.concatenate([np.arange(a, b) for a, b in zip(firsts, ends)])
        tokens, starts = self._paths(symbols[spread], bounds)
        token, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, (a, b) in enumerate(zip(firsts.tolist(), ends.tolist())):
            t, s = tokens[bounds[k] : bounds[k + 1]], starts[bounds[k] : bounds[k + 1]] - bounds[k] + a
            if k:
                cut = int(cuts[k])
                same = (token[a:cut] == t[: cut - a]) & (start[a:cut] == s[: cut - a])
                # Places up to which so many in a row are the same.
                row = np.convolve(same, np.ones(self.longest, np.int64), "valid") == self.longest
                if not row.any():
                    return self._paths(symbols, np.array([0, n]))
                a, t, s = cut, t[cut - a :], s[cut - a :]
            token[a:b], start[a:b] = t, s
        return token, start

    def _paths(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place, the token that ends there in the encoding of its word up to it, and where it begins."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        begin, size = bounds[:-1][order], sizes[order]
        token = np.zeros(len(symbols), np.int64)
        start = np.zeros(len(symbols), np.int64)
        word = at = node = np.zeros(0, np.int64)
        longest = int(size[0]) if len(size) else 0
        still = np.searchsorted(-size, -np.arange(longest), side="left")
        for step in range(longest):
            n = int(still[step])  # words that have a symbol here
            here = word < n
            word = np.concatenate([word[here], np.arange(n)])
            at = np.concatenate([at[here], begin[:n] + step])
            node = np.concatenate([node[here], np.zeros(n, np.int64)])
            node = self.arcs.get(node * self.symbols + symbols[begin[word] + step]).astype(np.int64)
            real = node >= 0
            word, at, node = word[real], at[real], node[real]
            ends = self.token_at[node]
            tried = np.flatnonzero(ends >= 0)
            # The longest token first; one of them continues the path.
            while len(tried):
                first = np.full(n, -1, np.int64)
                first[word[tried[::-1]]] = tried[::-1]
                pick = first[first >= 0]
                s, t, w = at[pick], ends[pick], word[pick]
                good = s == begin[w]
                rest = np.flatnonzero(~good)
                good[rest] = self.follows(token[s[rest] - 1], t[rest])
                place = begin[w[good]] + step
                token[place] = t[good]
                start[place] = s[good]
                done = np.zeros(n, bool)
                done[w[good]] = True
                drop = np.zeros(len(word), bool)
                drop[pick] = True
                tried = tried[~done[word[tried]] & ~drop[tried]]
        return token, start

    @staticmethod
    def _read(token: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths, read from the ends of the words."""
        live = np.flatnonzero(np.diff(bounds) > 0)
        place = bounds[1:][live] - 1
        counts = np.zeros(len(bounds) - 1, np.int64)
        steps = []
        while len(live):
            counts[live] += 1
            steps.append((live, token[place]))
            place = start[place] - 1
            more = place >= bounds[:-1][live]
            live, place = live[more], place[more]
        firsts = np.zeros(len(bounds), np.int64)
        np.cumsum(counts, out=firsts[1:])
        out = np.zeros(int(firsts[-1]), np.int64)
        for step, (words, tokens) in enumerate(steps):
            out[firsts[words] + counts[words] - 1 - step] = tokens
        return out, firsts


def compile_tokenizer(path: str) -> Automaton:
    """Automaton of a word tokenizer in the format of the tokenizers library, read by the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *specials.values()]) + 1
    left, right, rank = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    pairs = np.zeros(len(merges), np.int64)
    spelled: dict[int, tuple[int, ...]] = {}
    for b, shown in enumerate(byte_alphabet()):
        spelled[vocab[shown]] = (b,)
        spelled[vocab[shown + WORD_END]] = (256 + b,)
    for k, (u, v) in enumerate(merges):
        w = vocab[u + v]
        u, v = vocab[u], vocab[v]
        left[w], right[w], rank[w] = u, v, k
        pairs[k] = u * n + v
        spelled[w] = spelled[u] + spelled[v]
    # The symbols of the tokens as a tree; its arcs are the transitions on symbols.
    nodes, token_at = {(): 0}, {}
    arcs = {}
    for t, word in spelled.items():
        node = 0
        for i, s in enumerate(word):
            below = nodes.setdefault(word[: i + 1], len(nodes))
            arcs[node * 512 + s] = below
            node = below
        token_at[node] = t
    ends = np.full(len(nodes), -1, np.int64)
    ends[list(token_at)] = list(token_at.values())
    labels = [""] * n
    for text, t in [*vocab.items(), *specials.items()]:
        labels[t] = text
    return Automaton(
        left,
        right,
        rank,
        Lookup(pairs, np.arange(len(pairs))),
        Lookup(np.fromiter(arcs, np.int64), np.fromiter(arcs.values(), np.int64)),
        ends,
        pa.array([(x + " ").encode() for x in labels], pa.large_binary()),
        specials,
        max(map(len, spelled.values())),
    )


class SpecialSplit:
    """Splits a string at the special tokens and keeps them."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        names = sorted(ids, key=len, reverse=True)
        self.pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def parts(self, word: str) -> list[str]:
        return self.pattern.split(word) if self.pattern and "<|" in word else [word]


def _pieces(word: str, split: SpecialSplit) -> list[str | int]:
    """Pre-split words of a string without ASCII space; a number is a special token."""
    if "<|" not in word:
        # Each character is lower-cased by itself, so a capital sigma never becomes a final one.
        low = word if word.isascii() else unicodedata.normalize("NFC", word).replace("\u03a3", "\u03c3")
        low = low.lower()
        # Most words are letters, or letters and one mark behind them.
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        if word.isascii():
            return ASCII_SPLIT.findall(low)
    out: list[str | int] = []
    for part in split.parts(word):
        if part in split.ids:
            out.append(split.ids[part])
        elif NOT_KNOWN.search(part):
            out += _split_by_library(part)
        elif part:
            out += SPLIT.findall(unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower())
    return out


def _split_by_library(part: str) -> list[str]:
    """The same for characters that are newer than this Python, with the tables of the tokenizers library."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    plain = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(part)
    split = pre_tokenizers.Split(Regex(CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
    return [piece for piece, _ in split.pre_tokenize_str(plain)]


def _ragged(values: np.ndarray, firsts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that are chosen, one after the other, and their bounds."""
    sizes = (firsts[1:] - firsts[:-1])[chosen]
    bounds = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    # The largest arrays of a part: four bytes a place where they do.
    kind = np.int32 if max(bounds[-1], len(values)) < 2**31 else np.int64
    at = np.repeat((firsts[:-1][chosen] - bounds[:-1]).astype(kind), sizes)
    at += np.arange(bounds[-1], dtype=kind)
    return values[at], bounds


def encode_texts(texts: pa.Array, automaton: Automaton, split: SpecialSplit) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, text after text, and their bounds."""
    buf, offsets = text_buffer(texts)
    starts, ends, firsts = word_bounds(buf, offsets)
    ids, distinct = word_ids(buf, starts, ends)
    seen: dict[str, int] = {}
    flat, sizes = [], []
    special = -1
    for raw in distinct.to_pylist():
        pieces = _pieces(raw.decode(), split)
        sizes.append(len(pieces))
        for p in pieces:
            if isinstance(p, int):
                flat.append(special - p)
            else:
                flat.append(seen.setdefault(p, len(seen)))
    data = [p.encode() for p in seen]
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) for x in data], out=bounds[1:])
    symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    symbols[bounds[1:] - 1] += 256
    tokens, token_firsts = automaton.encode(symbols, bounds)
    # Special tokens are pieces of one token behind the others.
    if split.ids:
        largest = max(split.ids.values())
        tokens = np.concatenate([tokens, np.arange(largest + 1)])
        token_firsts = np.concatenate([token_firsts, token_firsts[-1] + 1 + np.arange(largest + 1)])
    piece = np.array(flat, np.int64)
    piece = np.where(piece < 0, len(data) + special - piece, piece)
    piece_firsts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=piece_firsts[1:])
    by_word, inner = _ragged(tokens.astype(np.int32), token_firsts, piece)
    word_firsts = inner[piece_firsts]
    out, word_bounds_ = _ragged(by_word, word_firsts, ids)
    return out, word_bounds_[firsts]


def decode_ids(ids: np.ndarray, bounds: np.ndarray, labels: pa.Array) -> pa.Array:
    """Texts of token ids: the labels, with a space between them."""
    taken = labels.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = taken.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = ends[bounds[:-1]], ends[bounds[1:]]
    # The space behind the last label of a text is left out.
    keep = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    full = last > first
    keep[last[full] - 1] = False
    sizes = np.zeros(len(bounds), np.int64)
    np.cumsum(last - first - full, out=sizes[1:])
    text = np.ascontiguousarray(data[: len(keep)][keep])
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(text)])


def ids_as_bytes(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Token ids of each text as little-endian unsigned 32-bit numbers."""
    data = np.ascontiguousarray(ids.astype("<u4"))
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4)), pa.py_buffer(data)]
    )


def encode_and_decode(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    carry: Sequence[str] | None = None,
    prefix: str = "",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``carry`` columns (all, if not given) with n_tokens, ids and decoded of every text.

    A task works on texts of ``part_bytes`` at a time, or on one; smaller parts take less memory and more time.

    ``tokenizer`` is the path of the vocabulary file on the driver; tasks get the compiled tables. ``ids``
    holds little-endian unsigned 32-bit numbers. Nothing is shuffled.
    """
    automaton = compile_tokenizer(tokenizer)

    def make():
        split = SpecialSplit(automaton.specials)

        def columns(texts: pa.Array) -> list:
            ids, bounds = encode_texts(texts, automaton, split)
            return [np.diff(bounds), ids_as_bytes(ids, bounds), decode_ids(ids, bounds, automaton.labels)]

        return columns

    out = f"`{prefix}n_tokens` bigint, `{prefix}ids` binary, `{prefix}decoded` string"
    return with_text_columns(df, make, out, text, carry, part_bytes)
