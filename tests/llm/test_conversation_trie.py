import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from counterfact.llm import conversation_trie
from counterfact.llm.conversation_trie import conversation_turns, prefix_trie, regrafted, shared_turns, skeleton
from tests.compare import connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SF = "/root/testdata/sf0.01"


def brute_force(paths: dict) -> set:
    """Nodes of the trie of {id: sequence of (role, text)}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = set()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(ids), len(node), parent, len(ids), len(kids), len(leaves), saved, sha))
    return out


def by_turn(rows) -> dict:
    """{id: sequence of (role, text)} of rows (id, turn, role, text) without ties."""
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    return {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in found.items()}


def rebuilt(own: dict) -> dict:
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, ())[:h] + own[c][h:]
    return out


def nodes_of(df) -> list:
    return [tuple(r) for r in df.collect()]


def made_up(n: int, seed: int) -> list:
    """Conversations over few texts, so that they share beginnings; a third of them are one conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 1:
            texts = ["Hello there.", "Good day to you", "bye"]
        else:
            texts = [rng.choice(["a b", "c", "", "d  e\nf"]) for _ in range(rng.randint(1, 6))]
        rows += [(c, t, "user" if t % 2 else "bot", x) for t, x in enumerate(texts)]
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_brute_force_whatever_the_shards(spark, shards):
    rows = made_up(300, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = nodes_of(prefix_trie(regrafted(conversation_turns(df)), shards=shards))
    assert len(got) == len(set(got)) and set(got) == brute_force(rebuilt(by_turn(rows)))


def test_without_rebuilding(spark):
    rows = made_up(120, 6)
    got = nodes_of(prefix_trie(conversation_turns(spark.createDataFrame(rows, SCHEMA)), shards=9))
    assert set(got) == brute_force(by_turn(rows)) and len(got) == len(set(got))


def test_query_equals_sql_and_brute_force(spark):
    got = entry.queries()["op11_conversation_trie"](spark, SF)
    con = connect(SF)
    sql = con.execute(entry.oracle_sql()["op11_conversation_trie"])
    assert got.columns == [c[0] for c in sql.description]
    nodes = nodes_of(got)
    assert sorted(map(str, nodes)) == sorted(map(str, sql.fetchall()))
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert set(nodes) == brute_force(rebuilt(by_turn(rows)))


def test_nulls_empty_texts_long_conversations_and_clashing_columns(spark):
    long = [(41, t, "user", f"turn {t} " + "word " * (t % 7)) for t in range(3_000)]
    copy = [(42, t, r, x) for _, t, r, x in long[:2_500]]
    rows = [
        (None, 1, "user", "lost"),
        (1, None, "user", "null first"),
        (1, 0, None, "x"),
        (1, 5, "user", None),
        (2, 3, "", ""),
        (3, 3, None, None),
        (20, 0, "user", "one"),
        (21, 0, "user", "one"),
        (21, 1, "bot", "word " * 50_000),
        (22, 0, "user", "gone"),
        *long,
        *copy,
    ]
    df = spark.createDataFrame([(*r, "p", 7, 8) for r in rows], f"{SCHEMA}, path string, shard int, words int")
    got = nodes_of(prefix_trie(conversation_turns(df), shards=5))
    own = by_turn(rows)
    short = {c: p for c, p in own.items() if c not in (41, 42)}
    assert {r for r in got if r[0] not in (41, 42) and r[1]} == {r for r in brute_force(short) if r[1]}
    root = next(r for r in got if r[1] == 0)
    assert root[:4] == (1, 0, None, len(own)) and len(got) == len(brute_force(short)) + 3_000
    assert {(r[1], r[3]) for r in got if r[0] == 41} == {(d, 2 if d <= 2_500 else 1) for d in range(1, 3_001)}


def test_ties_and_repeated_rows_have_one_result(spark):
    rows = [(5, 1, "a", "x"), (5, 1, "a", "x"), (5, 1, "b", "y"), (5, None, "c", "z"), (6, None, "c", "z")]
    results = set()
    for n in (1, 4):
        for order in (rows, rows[::-1]):
            turns = conversation_turns(spark.createDataFrame(order, SCHEMA).repartition(n))
            results.add(frozenset(nodes_of(prefix_trie(turns))))
    assert len(results) == 1
    assert sorted((r[0], r[1], r[3]) for r in results.pop()) == [(5, 0, 2), (5, 1, 2), (5, 2, 1), (5, 3, 1), (5, 4, 1)]


def test_empty_table_has_no_node(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nodes_of(prefix_trie(regrafted(conversation_turns(df)))) == []


def test_skeleton_is_the_trie_of_the_splitters_and_bounded(monkeypatch):
    rng = random.Random(3)
    paths = sorted((b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randint(0, 6))), c, 1) for c in range(200))
    splitters, ids, parents, depths = skeleton(paths, 12)
    prefixes = {p[: 16 * d] for p, _ in splitters for d in range(len(p) // 16 + 1)}
    assert len(parents) == len(prefixes) and all(parents[1:] < range(1, len(parents)))
    for (path, _), nodes in zip(splitters, ids):
        assert [depths[x] for x in nodes] == list(range(len(path) // 16 + 1))
        assert all(parents[b] == a for a, b in zip(nodes, nodes[1:]))
    monkeypatch.setattr(conversation_trie, "SKELETON_NODES", 10)
    assert len(skeleton(paths, 12)[2]) <= 10


def test_shared_turns():
    a = bytes(range(16)) * 300
    for n in (0, 1, 5, 70, 299):
        b = a[: 16 * n + 7] + b"\xff" + a[16 * n + 8 :]
        assert shared_turns(a, b) == shared_turns(b, a) == n
    assert shared_turns(a, a[:64]) == 4
