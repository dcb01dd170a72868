"""Language identification with error-correcting output codes.

Every language has a codeword of bits. A binary classifier for each bit, logistic regression on hashed byte
n-grams, predicts it from a text; the language is the one whose codeword has the least logistic loss under
the predicted margins. For few languages the code is exhaustive (all ways to part them in two), for more it
is the best of several random codes by least distance. A text is ambiguous if the second language is close.

The classifiers are trained on a bounded sample for each language by hash; all texts are read whole.

Defined cases: a null text and one without a letter are ``und`` with score 0; rows without a language are not
learned from; if no language is known, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact.llm.batches import LOWER, quoted, text_buffer, with_text_columns
from counterfact.llm.sampling import bucket_sample, remainder

UNKNOWN = "und"
#: Features of a text: byte n-grams up to this length, hashed to so many buckets each.
ORDERS, BUCKETS = 3, 1024
#: Texts whose features are counted at a time.
ROWS = 256

# Letters keep their lower-case byte, bytes of other characters stay, all else is a space.
KIND = np.full(256, 32, np.uint8)
KIND[[*range(97, 123)]] = np.arange(97, 123)
KIND[[*range(65, 91)]] = np.arange(97, 123)
KIND[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Training:
    """Bounds of the training: texts of a language, steps; the margin of an ambiguous text."""

    texts: int = 1000
    steps: int = 200
    rate: float = 0.5
    ridge: float = 1e-4
    margin: float = 0.1
    seed: int = 3


@dataclass
class Coder:
    """Languages, their codewords of -1 and 1, and the classifiers of the bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, for feature vectors."""
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        if len(self.languages) == 1:
            return self.languages * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        likely /= likely.sum(1, keepdims=True)
        order = np.sort(likely, axis=1)
        best = loss.argmin(1)
        return [self.languages[k] for k in best], likely.max(1), order[:, -1] - order[:, -2] < self.margin


def codewords(classes: int, rng: np.random.Generator) -> np.ndarray:
    """A code of -1 and 1 with a row for each class."""
    if classes <= 7:
        bits = [[(n >> k) & 1 for n in range(2 ** (classes - 1) - 1)] for k in range(classes - 1)]
        return 2 * np.array([[1] * (2 ** (classes - 1) - 1), *bits]) - 1
    length = max(15, 10 * int(np.ceil(np.log2(classes))))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice([-1, 1], (classes, length))
        apart = ((code[:, None, :] != code[None]).sum(2) + length * np.eye(classes, dtype=int)).min()
        useful = np.abs(code.sum(0)).max() < classes
        if useful and apart > far:
            best, far = code, apart
    return best if best is not None else code


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the n-gram counts of every text, each order of length one."""
    buf, offsets = text_buffer(texts)
    buf = KIND[buf]
    rows = len(offsets) - 1
    out = np.zeros((rows, ORDERS * BUCKETS), np.float32)
    for first in range(0, rows, ROWS):
        last = min(first + ROWS, rows)
        piece = buf[offsets[first] : offsets[last]].astype(np.uint32)
        sizes = np.diff(offsets[first : last + 1])
        doc = np.repeat(np.arange(last - first, dtype=np.int64), sizes)
        left = np.repeat(offsets[first + 1 : last + 1] - offsets[first], sizes) - np.arange(len(piece))
        gram = np.zeros(len(piece), np.uint32)
        for order in range(1, ORDERS + 1):
            short = len(piece) - order + 1
            if short <= 0:
                break
            gram = gram[:short] * np.uint32(257) + piece[order - 1 :]
            bucket = (gram * np.uint32(2654435761)) >> np.uint32(22)
            real = left[:short] >= order
            key = doc[:short][real] * BUCKETS + bucket[real]
            counts = np.bincount(key, minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)
            part = np.sqrt(counts)
            part /= np.maximum(np.sqrt(counts.sum(1, keepdims=True)), 1)
            out[first:last, (order - 1) * BUCKETS : order * BUCKETS] = part
    return out


def with_letter(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter."""
    buf, offsets = text_buffer(texts)
    lower = LOWER[buf]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((lower >= 97) & (lower <= 122), out=total[1:])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[k] = any(c.isalpha() for c in texts[k].as_py())
    return found


def learn(x: np.ndarray, labels: Sequence[str], rule: Training) -> Coder:
    """Codewords and classifiers, all bits at once by gradient steps with momentum."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Coder(languages, np.zeros((len(languages), 0)), np.zeros((0, 0)), np.zeros(0), rule.margin)
    code = codewords(len(languages), np.random.default_rng(rule.seed))
    which = np.array([languages.index(v) for v in labels])
    target = (code[which] > 0).astype(np.float32)
    # Every language has the same weight.
    mass = (1.0 / np.bincount(which))[which].astype(np.float32)[:, None] / len(languages)
    weights = np.zeros((x.shape[1], code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    push, push_bias = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rule.steps):
        wrong = (1 / (1 + np.exp(-(x @ weights + bias))) - target) * mass
        push = 0.9 * push + x.T @ wrong + rule.ridge * weights
        push_bias = 0.9 * push_bias + wrong.sum(0)
        weights -= rule.rate * 10 * push
        bias -= rule.rate * push_bias
    return Coder(languages, code, weights, bias, rule.margin)


def fit(
    df: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    rule: Training = Training(),
) -> Coder:
    """A coder from the rows for which ``learn_from`` holds, ``rule.texts`` of each language at most."""
    ident = F.col(quoted(id_col))
    usable = df.where(learn_from & F.col(quoted(lang)).isNotNull() & F.col(quoted(text)).isNotNull())
    language = F.col(quoted(lang)).cast("string").alias("lang")
    usable = usable.select(ident.alias("id"), language, F.col(quoted(text)).alias("text"))
    chosen = bucket_sample(usable, "id", rule.texts, ["lang"])
    texts = usable.join(F.broadcast(chosen), ["id", "lang"])

    def columns(t: pa.Array) -> list:
        data = np.ascontiguousarray(features(t).astype(np.float16))
        return [[row.tobytes() if has else None for row, has in zip(data, with_letter(t))]]

    made = with_text_columns(texts, lambda: columns, "vector binary", carry=["id", "lang"]).where("vector is not null")
    rows = made.groupBy("id", "lang").agg(F.min("vector").alias("vector")).orderBy("id", "lang").collect()
    if not rows:
        return learn(np.zeros((0, ORDERS * BUCKETS)), [], rule)
    x = np.stack([np.frombuffer(r["vector"], np.float16) for r in rows]).astype(np.float32)
    return learn(x, [r["lang"] for r in rows], rule)


def identify(df: DataFrame, coder: Coder, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``carry`` columns (all, if not given) with the language, its score and whether it is ambiguous."""

    def columns(texts: pa.Array) -> list:
        has = with_letter(pc.fill_null(texts, ""))
        languages, scores, close = [], [], []
        for first in range(0, len(texts), ROWS):
            found = coder.decode(features(texts.slice(first, ROWS)))
            languages += found[0]
            scores.append(found[1])
            close.append(found[2])
        score = np.where(has, np.concatenate(scores), 0.0).astype(np.float64)
        return [
            [v if h else UNKNOWN for v, h in zip(languages, has.tolist())],
            score,
            np.concatenate(close) | ~has,
        ]

    return with_text_columns(df, lambda: columns, "lang_pred string, score double, ambiguous boolean", text, carry)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a row without an id is one."""
    return (remainder(id_col, 4) == 2) | F.col(quoted(id_col)).isNull()
