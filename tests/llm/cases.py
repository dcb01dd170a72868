"""Small tables and plain versions of what the operators share."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n: int, seed: int) -> str:
    """Words made of syllables."""
    rng = random.Random(seed)
    parts = "an er in the of ti on re es th ea st nd or he ou ing ed".split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = prose(20_000, 1)
    same = prose(80, 2)
    return [
        (1, None, None, None, None),
        (None, same, "en", None, 3),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, "a", 4),
        (4, long, "en", "b", len(long)),
        (5, same, "en", "a", len(same)),
        (5, same, "en", "a", len(same)),
        (6, same, "fr", "b", len(same)),
        (7, "Écoutez — 日本語 🙂\nx\x00y", "fr", "b", 5),
        (8, "a", "en", "c", 1),
        (9, "word " * 400, "en", "c", 2000),
    ]


def edge_table(spark, extra: bool = True):
    """The rows above; ``extra`` adds columns with the names of computed ones."""
    rows = edge_rows()
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    names = "kept bigint, _text string, _c0 string, component_id string, `a.b` int, spans string, fp string, rows int"
    return spark.createDataFrame([(*r, 1, "t", "c", "k", 2, "s", "f", 4) for r in rows], f"{SCHEMA}, {names}")


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    """Union-find; a group is named by its least member."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def find(self, m):
        while self.parent[m] != m:
            self.parent[m] = self.parent[self.parent[m]]
            m = self.parent[m]
        return m

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
