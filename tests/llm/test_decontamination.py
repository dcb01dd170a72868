import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from counterfact.llm import decontamination
from counterfact.llm.decontamination import Rule, align, contaminated, with_matches
from tests.llm.cases import SCHEMA, edge_table, empty_table, prose

RULE = Rule()


def smith_waterman(a, b):
    table = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            step = 2 if a[j - 1] == b[i - 1] else -1
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_align_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(60):
        a = [[rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(5)]
        b = [[rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(5)]
        best, _ = align(np.array([x + [-1] * (20 - len(x)) for x in a]), np.array([x + [-2] * (12 - len(x)) for x in b]), RULE)
        assert best.tolist() == [smith_waterman(x, y) for x, y in zip(a, b)]


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


@pytest.fixture(scope="module")
def items():
    return [(k, prose(random.Random(k).randint(12, 50), 1000 + k)) for k in range(30)]


def planted(items):
    """Texts, and the items they hold: whole, edited, cut, in capitals."""
    rng = random.Random(5)
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        before, after = prose(rng.randint(0, 200), 2000 + k), prose(rng.randint(0, 200), 3000 + k)
        rows.append((k, f"{before} {text} {after}"))
        edited = [prose(1, rng.randrange(9999)) if rng.random() < 0.15 else w for w in text.split()]
        rows.append((100 + k, f"{before}\n{' '.join(edited)}\n{after}"))
        dropped = [w for w in text.split() if rng.random() > 0.1]
        rows.append((200 + k, f"{' '.join(dropped).upper()}, {after}"))
        rows.append((300 + k, f"{before} {after}"))
        want |= {(k, item), (100 + k, item), (200 + k, item)}
    return rows, want


def test_planted_copies_are_found_and_clean_texts_are_not(spark, items):
    rows, want = planted(items)
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = contaminated(table, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    texts, of = dict(rows), dict(items)
    for r in found:
        text, item = words(texts[r["doc_id"]]), words(of[r["item_id"]])
        score = smith_waterman(text, item) / (2 * len(item))
        assert abs(score - r["score"]) < 1e-9
        assert abs(smith_waterman(text[r["first_word"] : r["end_word"]], item) / (2 * len(item)) - score) < 1e-9


def test_all_pairs_above_the_share_are_found(spark, items):
    """Against aligning every text with every item."""
    rows, _ = planted(items[:8])
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(items[:8], "item_id bigint, text string")
    want = {
        (k, item)
        for k, text in rows
        for item, wanted in items[:8]
        if smith_waterman(words(text), words(wanted)) >= RULE.share * 2 * len(words(wanted))
    }
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(table, benchmark).collect()} == want


def test_blocks_of_items_give_the_same(spark, items):
    rows, want = planted(items)
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(str(k), t) for k, t in items], "item_id string, text string")
    found = contaminated(table, benchmark, rule=Rule(block_bytes=2500)).collect()
    assert {(r["doc_id"], int(r["item_id"])) for r in found} == want


def test_an_item_in_every_text(spark, items):
    """A copy that very many texts hold keeps its seeds."""
    text = items[0][1]
    table = spark.createDataFrame([(k, f"{prose(9, k)} {text}", None, None, None) for k in range(300)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert contaminated(table, benchmark).where("item_id = 0").count() == 300


def test_query(spark):
    d = entry.ENTRY_DIR
    found = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op9_decontamination"](spark, d).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    whole = {(k, i) for k, t in texts for i, b in bench if b in t}
    assert whole and whole <= found
    assert all(smith_waterman(words(dict(texts)[k]), words(dict(bench)[i])) >= 0.8 * len(words(dict(bench)[i])) for k, i in found)


def test_edges(spark, items):
    table = edge_table(spark)
    benchmark = spark.createDataFrame(
        [(1, None), (2, ""), (3, "a"), (None, prose(80, 2)), (4, prose(80, 2)), (5, "word " * 20)], "item_id int, text string"
    )
    found = contaminated(table, benchmark).collect()
    assert sorted(((r["doc_id"] or 0), (r["item_id"] or 0)) for r in found) == [
        (0, 0), (0, 4), (5, 0), (5, 0), (5, 4), (5, 4), (6, 0), (6, 4), (8, 3), *[(9, 5)] * 20
    ]
    assert contaminated(empty_table(spark), benchmark).count() == 0
    assert contaminated(table, benchmark.where("item_id < 0")).count() == 0
    marked = with_matches(table, benchmark.where("item_id < 0"))
    assert marked.columns == [*table.columns, "matches"] and marked.where("size(matches) = 0").count() == 11
    again = with_matches(marked.withColumnRenamed("matches", "Matches"), benchmark)
    assert again.columns == [*table.columns, "Matches", "matches_"]
    assert again.where("size(matches_) > 0").count() == 6 and again.where("size(Matches) = 0").count() == 11


def exact_copies(texts, item):
    """Non-overlapping places of a sequence of words in every text, from the left."""
    out = []
    for k, text in texts:
        at = 0
        while at + len(item) <= len(text):
            if text[at : at + len(item)] == item:
                out.append((k, at, at + len(item)))
                at += len(item)
            else:
                at += 1
    return sorted(out)


def test_short_items_are_searched_as_whole_sequences(spark):
    """Items of one to seven words; those of one and two are only found as whole texts."""
    base = prose(400, 9).replace(".", "").split()
    short = {n: " ".join(base[50 * n : 50 * n + n]) for n in range(1, 8)}
    rows = [(n, f"{prose(30, n)} {short[n]} {prose(30, 50 + n)}") for n in short]
    rows += [(20 + n, short[n].upper() + "!") for n in short]
    rows += [(40 + n, " ".join(short[n].split()[:-1] + ["other"])) for n in range(3, 8)]
    rows += [(60, f"{short[6]}, {short[6]} and {prose(9, 1)} {short[6]}")]
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(list(short.items()), "item_id int, text string")
    got = sorted((r["item_id"], r["doc_id"], r["first_word"], r["end_word"]) for r in contaminated(table, benchmark).collect())
    texts = [(k, words(t)) for k, t in rows]
    want = [(n, *c) for n in range(3, 8) for c in exact_copies(texts, words(short[n]))]
    want += [(n, 20 + n, 0, n) for n in (1, 2)]
    assert got == sorted(want) and sum(1 for g in got if g[1] == 60) == 3


def test_scripts_without_blanks(spark):
    """Characters are words: whole, edited and short items inside running text."""
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    item = "".join(rng.choice(signs) for _ in range(42))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(30))
    edited = "".join(rng.choice(signs) if rng.random() < 0.12 else c for c in item)
    filler = lambda n: "".join(rng.choice(signs) for _ in range(n))
    rows = [(1, filler(80) + item + filler(60)), (2, filler(50) + edited + "。" + filler(9)), (3, filler(200)),
            (4, f"see {thai} here"), (5, filler(30) + item[:5] + filler(30)), (6, "𠀀𠀁𠀂𠀃 x"), (7, filler(3))]
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame([(1, item), (2, thai), (3, item[:5]), (4, "𠀁𠀂𠀃")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(table, benchmark).collect()}
    assert got - {(2, 3)} == {(1, 1), (2, 1), (4, 2), (1, 3), (5, 3), (6, 4)}


def test_every_copy_is_reported(spark, items):
    text = items[3][1]
    n = len(words(text))
    rows = [(1, f"{text} {prose(300, 1)} {text}"), (2, f"{text} {text}\n{text}"), (3, prose(40, 2))]
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"], r["first_word"], r["end_word"]) for r in contaminated(table, benchmark).where("item_id = 3").collect())
    assert got == [(1, 0, n), (1, n + 300, 2 * n + 300), (2, 0, n), (2, n, 2 * n), (2, 2 * n, 3 * n)]


def test_items_of_one_text_are_matched_once(spark, items, monkeypatch):
    """Many rows of one text do not make a block larger, and each is reported."""
    rows, want = planted(items[:3])
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    many = [(i, t) for i, t in items[:3]] + [(1000 + k, items[0][1]) for k in range(200)]
    benchmark = spark.createDataFrame(many, "item_id bigint, text string")
    seen = []
    plain = decontamination.Items.__init__
    monkeypatch.setattr(decontamination.Items, "__init__", lambda s, names, texts, rule: (seen.append(len(texts)), plain(s, names, texts, rule))[1])
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(table, benchmark).collect()}
    assert got == want | {(d, 1000 + k) for d, i in want if i == 0 for k in range(200)} and seen == [3]


def test_tables_of_alignments_are_bounded(spark, monkeypatch, items):
    """A long text of chained seeds beside short passages, with small tables."""
    rows, want = planted(items[:5])
    rows.append((900, " ".join([items[1][1]] * 60)))
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    benchmark = spark.createDataFrame(items[:5], "item_id bigint, text string")
    largest = []
    plain = decontamination.align
    monkeypatch.setattr(decontamination, "CELLS", 500)
    monkeypatch.setattr(decontamination, "align", lambda p, i, r: (largest.append(p.shape), plain(p, i, r))[1])
    items_ = decontamination.Items([i for i, _ in items[:5]], [t for _, t in items[:5]], RULE)
    items_.choose_seeds(np.full(len(items_.vocabulary), 1e-6))
    found = decontamination.matches(pa.array([t for _, t in rows]), items_)
    assert {(rows[d][0], m["item_id"]) for d, here in enumerate(found) for m in here} == want | {(900, items[1][0])}
    assert len(found[-1]) == 60 and all(r == 1 or r * w <= 500 for r, w in largest)
