import math

import numpy as np
import pytest

import __spark_entry__ as entry
from counterfact.llm import embedding_dedup
from counterfact.llm.embedding_dedup import Index, Links, kmeans, near_copies
from counterfact.llm.vectors import units
from tests.compare import connect, differences
from tests.llm.cases import Groups

SCHEMA = "vec_id bigint, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def brute_force(rows, threshold=0.93):
    """{id: (links, component)} of rows (id, vector, label) with distinct ids."""
    whole = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        whole.setdefault((label, len(v)), []).append((i, v))
    links, groups = {i: 0 for i, *_ in rows}, Groups([i for i, *_ in rows])
    pairs = set()
    for members in whole.values():
        ids, x = [i for i, _ in members], units(np.array([v for _, v in members], np.float64))
        cos = x @ x.T
        for a, b in zip(*np.nonzero(np.triu(cos >= threshold, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            groups.join(ids[a], ids[b])
            pairs.add((ids[a], ids[b]))
    return {i: (links[i], groups.find(i)) for i in links}, pairs


def got_from(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def turned(rng, x, cos):
    """Vectors with the given cosine to ``x``."""
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return cos * x / np.linalg.norm(x, axis=1, keepdims=True) + math.sqrt(1 - cos * cos) * y


def made_up(seed=1, dense=300, single=900, dim=32):
    """One dense group with a shell of vectors in doubt around it, pairs near the threshold, and single ones."""
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(1, dim))
    group = turned(rng, np.repeat(center, dense, 0), 0.994)
    shell = np.vstack([turned(rng, np.repeat(center, 12, 0), c) for c in (0.97, 0.95, 0.93, 0.91, 0.88)])
    alone = rng.normal(size=(single, dim))
    pairs = np.vstack([turned(rng, alone[:100], c) for c in (0.99, 0.95, 0.935, 0.925)])
    x = np.vstack([group, shell, alone, pairs]).astype(np.float32)
    labels = np.concatenate([np.zeros(dense + len(shell), int), np.arange(single) % 2, np.tile(np.arange(100) % 2, 4)])
    order = rng.permutation(len(x))
    return [(int(i), [float(v) for v in x[j]], int(labels[j])) for i, j in enumerate(order)]


def settings(monkeypatch, **values):
    for name, value in values.items():
        monkeypatch.setattr(embedding_dedup, name, value)


def test_no_link_is_lost_in_one_list(spark):
    """With one list a label the index is exact, for dense groups and vectors at the threshold too."""
    rows = made_up()
    want, _ = brute_force(rows)
    got = got_from(near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == want


def test_pieces_change_nothing(spark, monkeypatch):
    rows = made_up(seed=2)
    settings(monkeypatch, PIECE=90, LIST_ROWS=1 << 30)
    want, _ = brute_force(rows)
    assert got_from(near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want
    settings(monkeypatch, PIECE=16)
    assert got_from(near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_balls_are_counted_not_compared(spark, monkeypatch):
    """The dense group forms a ball; without balls the result is the same."""
    rows = made_up(seed=3, single=200)
    want, _ = brute_force(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_from(near_copies(df)) == want
    settings(monkeypatch, BALL_LEAST=1 << 30)
    assert got_from(near_copies(df)) == want


def test_recall_over_many_lists(spark, monkeypatch):
    """Links that cross lists are found by probing; measured against brute force."""
    rows = made_up(seed=4, single=3_000, dim=64)
    settings(monkeypatch, LIST_ROWS=64)
    want, pairs = brute_force(rows)
    got = got_from(near_copies(spark.createDataFrame(rows, SCHEMA)))
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.99 * all_links
    single = {i for i in want if 0 < want[i][0] < 5}
    assert sum(got[i][0] for i in single) >= 0.9 * sum(want[i][0] for i in single)


def test_query_equals_sql_and_brute_force(spark):
    got = entry.queries()["op12_embedding_dedup"](spark, SF)
    con = connect(SF)
    assert differences(got.toPandas(), con.execute(entry.oracle_sql()["op12_embedding_dedup"]).df()) is None
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert got_from(got) == brute_force(rows)[0]


def test_nulls_zeros_lengths_copies_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [0.0, 0.0], 1),
        (4, [1.0, None], 1),
        (5, [1.0, nan], 1),
        (6, [inf, 1.0], 1),
        (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 1),
        (9, [2.0, 0.0], 1),
        (10, [1.0, 0.01], 1),
        (11, [1.0, 0.0], 2),
        (12, [1.0, 0.0, 0.0], 1),
        (13, [5.0, 0.0, 0.0], 1),
        (14, [-1.0, 0.0], 1),
        (15, [1e-40, 0.0], 1),
        (16, [3e38, 0.0], 1),
        (17, [0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], f"{SCHEMA}, row string, ball int, node int")
    got = near_copies(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got_from(got) == brute_force(rows)[0]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_doubles_and_many_exact_copies(spark):
    copies = [(i, [0.25, -0.5, 1.0], 1) for i in range(400)]
    other = [(1000 + i, [1.0, float(i), 0.0], 1) for i in range(5)]
    df = spark.createDataFrame(copies + other, "vec_id bigint, embedding array<double>, label string")
    assert got_from(near_copies(df)) == brute_force(copies + other)[0]


def test_missing_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (9, [0.0, 2.0], 1), (4, [-1.0, 0.0], 1)]
    got = near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (3, 1, 3, True), (9, 1, 3, False), (4, 0, 4, True)])
    )


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_error_is_within_the_stored_one():
    rng = np.random.default_rng(7)
    x = units(rng.normal(size=(500, 20)))
    index = Index(x, ["a"] * 500, 0.93, 4)
    p = index.place(x, ["a"] * 500)
    near = index.lookup(x, p["home"], p["codes"])
    assert (np.abs(near - x @ x.T) <= p["error"] + 1e-5).all()
    assert len(kmeans(x[:3], 8)) == 3


def test_links_hang_together():
    links = Links(6)
    links.add(np.array([4, 2]), np.array([5, 4]))
    links.add(np.array([2, 0]), np.array([1, 1]))
    assert links.group.tolist() == [0, 0, 0, 3, 0, 0] and links.count.tolist() == [1, 2, 2, 0, 2, 1]


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        near_copies(spark.createDataFrame([], SCHEMA), threshold=0)
