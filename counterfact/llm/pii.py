"""Personal data by a character tagger: base patterns, and spans that a BiLSTM with CRF adds.

The tagger is trained from labelled spans: those that the base patterns find in a bounded sample of texts,
and made-up ones in other notations, set into windows of the same texts. A text is decoded in overlapping
windows; at each character the scores of all windows over it are averaged, more weight to the window in whose
middle it lies, and one path is found over the whole stretch. An added span must have the shape of its kind
(digits, check sum, ranges) and touch no base span.

Every accepted span holds a digit, an ``@``, an ``at`` in brackets or the word ``dot``. So a stretch is decoded
wherever one occurs, with its surroundings, and nowhere else; that leaves out no span.

Defined cases: a null or empty text has no spans; repeated rows are tagged one by one; without texts to learn
from, the tagger learns from made-up windows alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfact.llm.batches import quoted, text_buffer, with_text_columns
from counterfact.llm.sampling import bucket_sample
from counterfact.llm.tagger import Params, Shape, best_path, emissions, train

# Kinds in order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that does not begin a run of digits cannot begin an address that its run does not begin.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Tags: none, then first and further character of each kind.
TAGS = 1 + 2 * len(KINDS)

#: Symbols of the tagger: outside the text, ASCII, other letters, other characters.
SYMBOLS = 131

#: Characters of a window, between windows, and around a character that may belong to a span.
WINDOW, STRIDE, AROUND = 64, 32, 64
#: Windows that are scored at a time.
WINDOWS = 1024


@dataclass(frozen=True)
class Training:
    """Bounds of the training: texts of the sample, windows of a text, made-up windows, batches."""

    texts: int = 2000
    windows_each: int = 4
    made: int = 6000
    steps: int = 900
    seed: int = 11


def luhn(digits: str) -> bool:
    """Whether the check sum of a card number holds."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (2 if n % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _byte(number: str) -> bool:
    """Whether a number of any length is at most 255."""
    short = number.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    found = []
    at = text.find("@")
    before = 0
    while at >= 0:
        start = at
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            before = domain.end()
        at = text.find("@", max(at + 1, before))
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


# Shapes of added spans; a span is stripped of spaces and punctuation at its ends first.
# Addresses may have letters of any script, and their signs as words or in brackets.
_DOT = r"(?:\s?\.\s?|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
_AT = r"(?:\s?[(\[{]\s?(?:@|at)\s?[)\]}]\s?|\s?@\s?|\sat\s)"
_NAME, _LABEL = r"[\w%+-]+", r"[^\W_](?:[\w-]*[^\W_])?"
_EMAIL_SHAPE = re.compile(rf"{_NAME}(?:{_DOT}{_NAME})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.IGNORECASE)
# What every added span has one of.
_MARK = r"[0-9@]|[(\[{]\s?at\s?[)\]}]|\bdot\b"
MARK = re.compile(_MARK, re.IGNORECASE)
_IP_SHAPE = re.compile(r"([0-9]{1,3})(?:\s?(?:\.|\[\.\]|\(\.\))\s?([0-9]{1,3})){3}")
_PHONE_SHAPE = re.compile(r"[+(]?[0-9][\x20().0-9/-]+[0-9]")
_PHONE_GROUPS = re.compile(r"[0-9]+")


def fits(kind: int, value: str) -> bool:
    """Whether an added span has the shape of its kind."""
    digits = _digits(value)
    if kind == 0:
        # The signs as mere words are not enough for one: " at " and a full stop occur in any text.
        spelled = "@" in value or MARK.search(value.replace("@", "")) is not None
        return spelled and bool(_EMAIL_SHAPE.fullmatch(value)) and not _digits(value) == value
    if kind == 1:
        return bool(_IP_SHAPE.fullmatch(value)) and all(int(p) <= 255 for p in _PHONE_GROUPS.findall(value))
    if kind == 2:
        marks = sum(not c.isalnum() for c in value)
        return 16 <= len(digits) <= 19 and luhn(digits) and marks == len(value) - len(digits)
    groups = _PHONE_GROUPS.findall(value)
    grouped = len(groups) >= 3 and max(map(len, groups)) <= 5
    dotted = re.search(r"\.[0-9]+\.[0-9]+\.", value)
    return 8 <= len(digits) <= 15 and grouped and not dotted and bool(_PHONE_SHAPE.fullmatch(value))


def symbols_of(text: str) -> np.ndarray:
    """Symbols of the characters of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = codes + 1
    wide = np.flatnonzero(codes >= 128)
    for k in wide.tolist():
        out[k] = 129 if text[k].isalpha() else 130
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches with every character that an added span must have one of, and what is around them."""
    at = [m.start() for m in MARK.finditer(text)]
    found: list[list[int]] = []
    for k in at:
        lo, hi = max(0, k - AROUND), min(len(text), k + AROUND + 1)
        if found and lo <= found[-1][1]:
            found[-1][1] = hi
        else:
            found.append([lo, hi])
    return [(a, b) for a, b in found]


def _window(symbols: np.ndarray, start: int) -> np.ndarray:
    """Symbols of a window; places outside the text have symbol zero."""
    out = np.zeros(WINDOW, np.int64)
    lo, hi = max(0, start), min(len(symbols), start + WINDOW)
    if hi > lo:
        out[lo - start : hi - start] = symbols[lo:hi]
    return out


def _tagged(spans: Sequence[tuple[int, int, int]], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, s, e in spans:
        lo, hi = max(s, start), min(e, start + WINDOW)
        if hi > lo:
            tags[lo - start : hi - start] = 2 + 2 * kind
            if s >= start:
                tags[s - start] = 1 + 2 * kind
    return tags


# ---- training


def _made_up(kind: int, rng: np.random.Generator) -> str:
    """A value of a kind in one of several notations."""
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: options[int(rng.integers(0, len(options)))]
    if kind == 0:
        plain = ("@", ".")
        at, dot = pick(
            plain, plain, (" @ ", "."), (" @ ", " . "), ("(@)", "."), ("[@]", "[dot]"), (" [at] ", "."), ("[at]", "[dot]"),
            (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "),
        )
        between = dot if " dot" in dot.lower() else "."
        name = word(int(rng.integers(2, 9))) + pick("", between, "_", "-") + pick(number(2), word(4))
        host = word(int(rng.integers(3, 8)))
        if rng.random() < 0.25:
            name, host = (x.translate(str.maketrans("aoue", pick("äöüé", "åøúê", "αουε")))[::1] for x in (name, host))
        top = pick("com", "org", "net", "de", f"example{dot}com")
        return name + at + host + pick("", number(1)) + dot + top
    if kind == 1:
        return pick(".", ".", "[.]", " . ").join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits = number(15)
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        return pick("", "", " ", "-", ".", "/").join(digits[i : i + 4] for i in range(0, 16, 4))
    groups = pick(
        ("+", "1", number(3), number(3), number(4)),
        ("", number(3), number(3), number(4)),
        ("+", number(2), number(3), number(4), number(2)),
    )
    if rng.random() < 0.5:
        groups = (*groups[:-3], f"({groups[-3]})", *groups[-2:])
    return groups[0] + pick(" ", "-", ".", " ").join(groups[1:])


def _distraction(rng: np.random.Generator) -> str:
    """Something with digits that is of no kind."""
    n = int(rng.integers(1, 7))
    options = [
        "".join(map(str, rng.integers(0, 10, n))),
        f"{rng.integers(1, 32)}.{rng.integers(1, 13)}.{rng.integers(1900, 2030)}",
        f"{rng.integers(0, 24)}:{rng.integers(10, 60)}",
        f"{rng.integers(0, 99)},{rng.integers(100, 999)}",
        "".join(rng.choice(list("0123456789abcdef"), 32)),
        "v" + ".".join(map(str, rng.integers(0, 20, 3))),
        f"{rng.integers(1, 99)} @ {rng.integers(1, 99)}",
        "the dot at the end of it",
        "look at the dot",
        "a dot matrix at home",
        "see [at] there",
    ]
    return options[int(rng.integers(0, len(options)))]


def training_windows(contexts: Sequence[str], rule: Training) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows: contexts as they are, and with a made-up value set in."""
    rng = np.random.default_rng(rule.seed)
    plain = [c for c in contexts if c] or ["abc def ghij klm nop. " * 3]
    x, y = [], []
    for text in plain:
        x.append(_window(symbols_of(text), 0))
        y.append(_tagged(base_spans(text), 0))
    for n in range(rule.made):
        text = plain[int(rng.integers(0, len(plain)))]
        at = int(rng.integers(0, min(len(text), 48) + 1))
        kind = n % (len(KINDS) + 1)
        value = _made_up(kind, rng) if kind < len(KINDS) else _distraction(rng)
        whole = f"{text[:at]} {value} {text[at:]}"
        spans = [s for s in base_spans(whole) if s[2] <= at + 1 or s[1] > at + len(value)]
        if kind < len(KINDS):
            spans.append((kind, at + 1, at + 1 + len(value)))
        x.append(_window(symbols_of(whole), 0))
        y.append(_tagged(spans, 0))
    return np.array(x), np.array(y)


def _sample_windows(texts: pa.Array, rule: Training) -> list[list[str]]:
    """Windows of each text: around base spans first, then spread evenly."""
    out = []
    for text in pc.fill_null(texts, "").to_pylist():
        starts = [max(0, s - 20) for _, s, _ in base_spans(text)[: rule.windows_each]]
        free = rule.windows_each - len(starts)
        starts += [len(text) * (2 * k + 1) // (2 * free) for k in range(free)]
        out.append([text[s : s + WINDOW] for s in starts])
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", rule: Training = Training()) -> Params:
    """A tagger from a sample of at most ``rule.texts`` texts, the least id of each bucket of hashes.

    The driver gets ``rule.windows_each`` windows of 64 characters of each.
    """
    ident = F.col(quoted(id_col))
    chosen = bucket_sample(df.select(ident.alias("id")), "id", rule.texts)
    texts = df.select(ident.alias("id"), F.col(quoted(text)).alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    windows = with_text_columns(
        texts, lambda: lambda t: [_sample_windows(t, rule)], "windows array<string>", carry=["id"]
    )
    # Repeated rows add nothing; the bound holds for them too.
    rows = windows.groupBy("id").agg(F.min("windows").alias("windows")).orderBy(F.xxhash64("id"), "id").collect()
    contexts = [w for row in rows for w in row["windows"]]
    x, y = training_windows(contexts, rule)
    return train(x, y, Shape(SYMBOLS, TAGS), rule.steps, seed=rule.seed)


# ---- tagging


def _path_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    spans, kind, start = [], -1, 0
    for k, tag in enumerate([*tags.tolist(), 0]):
        of = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (of != kind or tag == 1 + 2 * of):
            spans.append((kind, start, k))
            kind = -1
        if of >= 0 and kind < 0:
            kind, start = of, k
    return spans


def added_spans(text: str, stretch: tuple[int, int], path: np.ndarray, base: list[tuple[int, int, int]]) -> list:
    """Spans of a decoded stretch that fit their kind and touch no base span."""
    out: list[tuple[int, int, int]] = []
    for kind, s, e in _path_spans(path):
        s, e = s + stretch[0], e + stretch[0]
        if kind == 0:
            s, e = _whole_address(text, s, e)
        while s < e and (text[s].isspace() or text[s] in ",;:.!?'\""):
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ",;:.!?'\""):
            e -= 1
        whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        if s < e and whole and fits(kind, text[s:e]) and not any(s < y and x < e for _, x, y in base):
            if (kind, s, e) not in out:
                out.append((kind, s, e))
    return out


def _whole_address(text: str, s: int, e: int) -> tuple[int, int]:
    """The address that a tagged part belongs to, as far as its shape reaches; the part itself if there is none.

    An address in words has several parts, of which the tagger may mark one.
    """
    lo = max(0, s - 2 * AROUND)
    for m in _EMAIL_SHAPE.finditer(text[lo : e + 2 * AROUND]):
        if m.start() + lo < e and s < m.end() + lo:
            return m.start() + lo, m.end() + lo
    return s, e


def find_spans(texts: Sequence[str], params: Params) -> list[tuple[list, list]]:
    """Base spans and all spans (kind, start, end) of every text, by kind, then start."""
    weight = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    found = [(base_spans(t), []) for t in texts]
    jobs = []  # text, stretch, first window, number of windows
    windows: list[np.ndarray] = []

    def flush() -> None:
        if not jobs:
            return
        scores = np.concatenate(
            [emissions(params, np.array(windows[k : k + WINDOWS])) for k in range(0, len(windows), WINDOWS)]
        )
        for n, (a, b), first, count in jobs:
            size = b - a
            total = np.zeros((count * STRIDE + WINDOW, TAGS))
            mass = np.zeros(len(total))
            for k in range(count):
                at = k * STRIDE
                total[at : at + WINDOW] += weight[:, None] * scores[first + k]
                mass[at : at + WINDOW] += weight
            # The first window begins before the stretch, so that its beginning is seen by two.
            merged = (total / np.maximum(mass, 1)[:, None])[STRIDE : STRIDE + size]
            path = best_path(params, merged)
            if path.any():
                found[n][1].extend(added_spans(texts[n], (a, b), path, found[n][0]))
        jobs.clear()
        windows.clear()

    for n, text in enumerate(texts):
        around = stretches(text)
        if not around:
            continue
        symbols = symbols_of(text)
        for a, b in around:
            starts = range(a - STRIDE, b, STRIDE)
            jobs.append((n, (a, b), len(windows), len(starts)))
            windows.extend(_window(symbols, s) for s in starts)
            if len(windows) >= 4 * WINDOWS:
                flush()
    flush()
    return [(sorted(base), sorted(base + added)) for base, added in found]


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    """Spans as text."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _may_hold(texts: pa.Array) -> np.ndarray:
    """Which texts have what every span has one of, from their bytes where these are enough."""
    buf, offsets = text_buffer(texts)
    marks = np.zeros(256, bool)
    marks[[*range(48, 58), 64]] = True
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(marks[buf], out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    rest = np.flatnonzero(~out)
    words = pc.match_substring_regex(texts.take(pa.array(rest)), r"(?i)[(\[{]\s?at\s?[)\]}]|\bdot\b")
    out[rest] = pc.fill_null(words, False).to_numpy(zero_copy_only=False)
    return out


def redacted(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with each span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        end = -end
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    out.append(text[at:])
    return "".join(out)


def _each(texts: pa.Array, params: Params) -> list[tuple[str, list, list]]:
    filled = pc.fill_null(texts, "")
    may = _may_hold(filled)
    out: list[tuple[str, list, list]] = [("", [], [])] * len(filled)
    chosen = np.flatnonzero(may)
    values = filled.take(pa.array(chosen)).to_pylist()
    for n, value, (base, spans) in zip(chosen.tolist(), values, find_spans(values, params)):
        out[n] = (value, base, spans)
    return out


def tag_pii(
    df: DataFrame,
    params: Params | Callable[[], Params],
    text: str = "text",
    carry: Sequence[str] | None = None,
    redact: bool = False,
    column: str = "redacted",
) -> DataFrame:
    """``carry`` columns (all, if not given) with counts of the base kinds, digest of the base spans, all spans.

    With ``redact``, the only added column is ``column``: the text with its spans replaced; null for null.
    Nothing is shuffled. ``params`` is a few ten kilobytes that every task gets.
    """

    def columns(texts: pa.Array) -> list:
        found = _each(texts, params)
        counts = [[sum(k == kind for k, _, _ in base) for _, base, _ in found] for kind in range(len(KINDS))]
        digests = [hashlib.sha256(written(base).encode()).hexdigest() for _, base, _ in found]
        return [*counts, digests, [written(spans) for _, _, spans in found]]

    def replaced(texts: pa.Array) -> list:
        hit = np.zeros(len(texts), bool)
        new = []
        for n, (value, _, spans) in enumerate(_each(texts, params)):
            if spans:
                hit[n] = True
                new.append(redacted(value, spans))
        return [pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))]

    if redact:
        return with_text_columns(df, lambda: replaced, f"`{column}` string", text, carry)
    out = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return with_text_columns(df, lambda: columns, out, text, carry)
