import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from counterfact.llm.pii import (
    KINDS,
    SYMBOLS,
    TAGS,
    Training,
    base_spans,
    find_spans,
    fit,
    fits,
    luhn,
    redacted,
    stretches,
    tag_pii,
    training_windows,
    written,
)
from counterfact.llm.tagger import Shape, best_path, loss_and_gradient, start_params, train
from tests.llm.cases import SCHEMA, edge_table, empty_table, prose


@pytest.fixture(scope="module")
def tagger():
    x, y = training_windows([prose(20, k) for k in range(200)], Training())
    return train(x, y, Shape(SYMBOLS, TAGS), Training().steps, seed=11)


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def test_base_equals_brute_force():
    rng = random.Random(2)
    bits = ["a", "b.", "@", ".", "-", "1", "22", "255", "0007", "4", ".", " ", "+", "(", ")", "é", "x@y.z", "٣",
            "12345678", "\n", "4111 1111-11111111", "🙂"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert sorted(base_spans(text)) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+" + "1" * 300_000, "1." * 100_000, "@" * 50_000):
        base_spans(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in start_params(Shape(20, 5, 4, 3), rng).items()}
    x, y = rng.integers(0, 20, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grad = loss_and_gradient(params, x, y)
    for name in params:
        at = (x[0, 2], 1) if name == "embed" else tuple(int(rng.integers(0, s)) for s in params[name].shape)
        ends = []
        for step in (0.01, -0.01):
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][at] += step
            ends.append(loss_and_gradient(moved, x, y)[0])
        assert abs((ends[0] - ends[1]) / 0.02 - grad[name][at]) < 2e-3, name


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(3)
    params = {"start": rng.normal(size=3), "move": rng.normal(size=(3, 3))}
    scores = rng.normal(size=(5, 3))

    def total(path):
        steps = sum(params["move"][a, b] for a, b in zip(path, path[1:]))
        return params["start"][path[0]] + steps + sum(scores[t, k] for t, k in enumerate(path))

    best = max(np.ndindex(*[3] * 5), key=total)
    assert best_path(params, scores).tolist() == list(best)


def test_stretches_hold_every_mark():
    text = prose(300, 4) + " 12 " + prose(100, 5) + " x@y"
    around = stretches(text)
    for k, c in enumerate(text):
        if c.isdigit() or c == "@":
            assert any(a <= k < b for a, b in around)


def test_tagger_adds_other_notations(tagger):
    kinds = set()
    for text in (
        f"{prose(9, 1)} call (212) 555-0199 {prose(9, 2)}",
        f"{prose(9, 3)} 10[.]0[.]0[.]1 {prose(9, 4)}",
        f"{prose(9, 5)} 4111.1111.1111.1111 {prose(9, 6)}",
    ):
        base, spans = find_spans([text], tagger)[0]
        assert not base
        kinds |= {KINDS[k] for k, _, _ in spans}
    assert len(kinds) >= 2


SPELLED = [
    "name [at] example.com",
    "jane dot doe at example dot com",
    "j.smith (at) mail (dot) example (dot) org",
    "müller@exämple.de",
    "kontakt[at]firma[dot]net",
    "bob.stone AT server DOT com",
]


def test_spelled_out_addresses_have_the_shape():
    assert all(fits(0, value) for value in SPELLED)
    for value in ("look at home", "meet at noon. then", "dot", "at dot", "12 @ 13", "a at b", "he was at example.com", "1234"):
        assert not fits(0, value)


def test_spelled_out_addresses_are_found(tagger):
    """Most of them, in prose; the tagger decides where they begin and end."""
    found = 0
    for k, value in enumerate(SPELLED):
        for n in range(5):
            before = f"{prose(12, 40 * k + n)} "
            text = f"{before}{value} {prose(12, 40 * k + n + 20)}"
            base, spans = find_spans([text], tagger)[0]
            found += (0, len(before), len(before) + len(value)) in spans
    assert found >= 0.7 * 5 * len(SPELLED)


def test_words_of_addresses_in_prose_are_none(tagger):
    texts = [f"{prose(15, k)} {x} {prose(15, 99 + k)}" for k in range(20) for x in (
        "look at the dot over there", "a dot. at last", "the polka dot dress at home", "we met at noon", "see [at] the end",
    )]
    assert not any(spans for _, spans in find_spans(texts, tagger))


def test_a_name_longer_than_a_window(tagger):
    assert any(a == 0 for a, _ in stretches("x" * 60 + " [at] example.com"))


def test_clean_texts_stay_clean(tagger):
    rng = random.Random(6)
    texts = [f"{prose(30, k)} {rng.randint(1, 10 ** rng.randint(1, 12))} {prose(20, 99 + k)} 12.10.2020 10:30" for k in range(60)]
    assert not any(spans for _, spans in find_spans(texts, tagger))


def test_base_spans_stay(tagger):
    text = f"{prose(40, 1)} a.b@mail.example.com {prose(40, 2)} +1 (243) 555-5526 {prose(9, 3)} 4111111111111111 at 1.2.3.4"
    base, spans = find_spans([text], tagger)[0]
    assert [KINDS[k] for k, _, _ in base] == ["email", "ip", "card", "phone"]
    assert set(base) <= set(spans)


def test_redacted():
    assert redacted("a x@y.z b", [(0, 2, 7)]) == "a <EMAIL> b"
    assert redacted("0123456789", [(2, 1, 5), (3, 3, 8)]) == "0<CARD>89"
    assert redacted("", []) == ""


def test_query(spark):
    rows = entry.queries()["op5_pii"](spark, entry.ENTRY_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{entry.ENTRY_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert {written([s]) for s in base} <= set(r["spans"].split(","))


def test_edges(spark, tagger):
    table = edge_table(spark)
    out = tag_pii(table, tagger).collect()
    assert len(out) == 11 and all(r["spans"] == "" for r in out)
    kept = {r["doc_id"]: r["redacted"] for r in tag_pii(table, tagger, redact=True).collect()}
    assert kept[1] is None and kept[2] == "" and kept[8] == "a"
    assert tag_pii(empty_table(spark), tagger).count() == 0
    small = Training(steps=2, made=10)
    assert fit(empty_table(spark), rule=small) and fit(table, rule=small)
    one = spark.createDataFrame([(1, "x a@b.c y", "en", "s", 9)], SCHEMA)
    assert tag_pii(one, tagger, redact=True).first()["redacted"] == "x <EMAIL> y"
