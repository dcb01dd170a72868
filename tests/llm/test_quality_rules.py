import collections
import random

import pyarrow as pa
import pytest

from counterfact.llm.quality_rules import Limits, measure, quality_rules
from tests.llm.cases import WORD, edge_table, empty_table

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words",
    "longest_repeat",
]


def brute(text, limits):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    places = collections.defaultdict(list)
    for i in range(n - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = {i + k for i, b in enumerate(best) if b >= limits.min_repeat for k in range(b)}
    failed = n < 50 or 100 * len(repeated) > 50 * n
    longest = max(best, default=0)
    allowed = max(limits.max_longest, limits.long_share * n)
    kept = not failed and len(covered) <= limits.max_covered * n and longest <= allowed
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed, kept, len(covered), longest]


@pytest.mark.parametrize("limits", [Limits(), Limits(min_repeat=2, max_covered=0.1, max_longest=5)])
def test_measures_equal_brute_force(limits):
    rng = random.Random(1)
    bits = ["a", "b", "é", "\n", " ", "  ", "# ", "a b c d e f g h i ", "\x0b", "longer "]
    texts = [None, "", " \n ", "a", "é é  é\x0b é", "x " * 60]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 90))) for _ in range(200)]
    texts += [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9)}" for _ in range(70)) for _ in range(30)]
    got = measure(pa.array(texts), limits)
    for k, text in enumerate(texts):
        assert [c[k] for c in got] == brute(text, limits), text


def test_the_verdict_rejects_what_the_base_misses():
    """A long passage pasted twice; the base rule asks for half of a text."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = fresh(300), fresh(20)
    texts = {
        "pasted": fresh(650) + passage + fresh(650) + passage,
        "once": fresh(650) + passage + fresh(650),
        "boilerplate": fresh(500) + line + fresh(500) + line + fresh(500) + line,
        "long": (lead := fresh(1500)) + fresh(20_000) + lead,
        "mostly": [w for _ in range(12) for w in fresh(10) + line[:9]],
    }
    got = measure(pa.array([" ".join(t) for t in texts.values()]), Limits())
    failed, kept = (dict(zip(texts, got[k].tolist())) for k in (5, 6))
    assert not any(failed[k] for k in ("pasted", "once", "boilerplate", "long", "mostly"))
    assert kept == {"pasted": False, "once": True, "boilerplate": True, "long": True, "mostly": False}


def test_edges(spark):
    table = edge_table(spark)
    out = quality_rules(table)
    assert out.columns == [c for c in table.columns if c != "kept"] + MEASURES
    rows = out.collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    for k in (1, 2, 3):
        assert by[k]["n_words"] == 0 and by[k]["base_failed"] and not by[k]["kept"]
    assert by[4]["kept"] and by[5]["kept"] and not by[9]["kept"]
    assert by[9]["longest_repeat"] == 399
    assert quality_rules(empty_table(spark)).count() == 0
