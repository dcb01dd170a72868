import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from counterfact.llm import hard_negatives as module
from counterfact.llm.hard_negatives import BEST, Best, Tree, hard_negatives, search, spanning_tree
from tests.compare import connect, differences

SCHEMA = "vec_id bigint, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows, by=50, positives=5, negatives=3, kind=np.float32):
    """Rows of the result, from rows (id, vector, label)."""
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(kind(x))) for x in v]
        if sum(x * x for x in q) < 1 << 62:
            usable.append((i, q, label))
    out = []
    for a, av, al in usable:
        if a % by:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label == al) for i, v, label in usable if i != a and len(v) == len(av))
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            hits = [(s, i) for s, i, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(hits[:negatives])]
    return sorted(out)


def mined(df, **settings):
    got = hard_negatives(df, F.col("vec_id") % settings.pop("by", 50) == 0, **settings)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def made_up(n=900, dim=12, seed=1, copies=True):
    """Groups of near copies over several labels, so that anchors lie near each other, and a hot label."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dim))
    if copies:
        x[: n // 3] = x[0]
    labels = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 6, n))
    ids = rng.permutation(3 * n)[:n]
    return [(int(i), [float(v) for v in row], int(label)) for i, row, label in zip(ids, x.astype(np.float32), labels)]


@pytest.mark.parametrize("tree, group_bytes", [(256, 16 << 20), (8, 16 << 20), (16, 3_000)])
def test_equals_brute_force_whatever_the_trees(spark, monkeypatch, tree, group_bytes):
    monkeypatch.setattr(module, "TREE", tree)
    monkeypatch.setattr(module, "GROUP_BYTES", group_bytes)
    rows = made_up()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df, by=20) == brute_force(rows, by=20)


def test_other_settings(spark):
    rows = made_up(300, seed=2, copies=False)
    want = brute_force(rows, by=7, positives=2, negatives=40)
    assert mined(spark.createDataFrame(rows, SCHEMA), by=7, positives=2, negatives=40) == want


def test_query_equals_sql_and_brute_force(spark):
    got = entry.queries()["op13_hard_negatives"](spark, SF)
    con = connect(SF)
    assert differences(got.toPandas(), con.execute(entry.oracle_sql()["op13_hard_negatives"]).df()) is None
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_force(moved)


def test_nulls_lengths_large_values_ties_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1),
        (50, [-1.0, 0.25], 1),
        (100, None, 1),
        (150, [nan, 1.0], 1),
        (200, [1.0, 1.0], None),
        (250, [], 3),
        (251, [], 3),
        (252, [], 4),
        (300, [1.0, 0.5, 1.0], 1),
        (301, [1.0, 0.5, 1.0], 1),
        (302, [0.75, 0.5, 1.0], 2),
        (350, [1e30, 1.0], 1),
        (400, [3e5, -2e5], 1),
        (401, [2e5, -2e5], 1),
        (402, [1.4e5, -2e5], 2),
        (None, [1.0, 0.5], 2),
        (7, [0.9, 0.5], 2),
        (8, [0.9, 0.5], 2),
        (9, [0.9, 0.5], 2),
        (3, [0.9, 0.5], 2),
        (10, [0.9, None], 2),
        (11, [inf, 0.5], 2),
        (12, [0.95, 0.5], 1),
        (13, [0.8, 0.5], 2),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{SCHEMA}, anchor string, place int, score int")
    want = brute_force(rows)
    assert mined(df) == want and {r[0] for r in want} >= {0, 250, 300, 400}


def test_scores_beyond_exact_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 2e5 + 1e6], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    assert mined(df) == brute_force(rows, kind=np.float64)


def test_repeated_anchors_and_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (2, [0.75, 0.0], 2)]
    want = [(0, 1, r, 2, 65536, 49152) for r in (1, 1, 2, 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == want


def test_empty_table_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_bounds_spare_scores():
    """Candidates whose bounds miss the window are not scored, and none is lost."""
    rng = np.random.default_rng(5)
    anchors = (rng.normal(size=(1, 16)) * 256 + rng.normal(size=(60, 16)) * 4).astype(np.int64)
    rows = (rng.normal(size=(1500, 16)) * 256).astype(np.int64)
    tree = Tree(anchors, spanning_tree(anchors.astype(np.float64)))
    full = np.ones((60, 1500), bool)
    low, high = np.full((60, 1), BEST.min), np.full((60, 1), BEST.max)
    best = Best(60, 5)
    search(tree, rows[:100], np.arange(100), full[:, :100], low, high, best)
    scored = search(tree, rows[100:], np.arange(100, 1500), full[:, 100:], low, high, best)
    want = np.argsort(-(anchors @ rows.T), axis=1, kind="stable")[:, :5]
    assert (best.id == want).all()
    assert scored < 0.3 * 60 * 1400


def test_tree_is_a_least_spanning_tree():
    x = np.random.default_rng(6).normal(size=(40, 5))
    parents = spanning_tree(x)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    total = sum(away[i, p] for i, p in enumerate(parents) if p >= 0)
    edges, group, least = sorted((away[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0
    for d, i, j in edges:
        if group[i] != group[j]:
            group, least = [group[i] if g == group[j] else g for g in group], least + d
    assert (parents < 0).sum() == 1 and total == pytest.approx(least)
