import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from counterfact.llm import simhash
from counterfact.llm.components import components
from counterfact.llm.simhash import fingerprints, gray_rank, near_duplicates, one_of_each, spanning_links
from tests.llm.cases import ASCII_LOWER, SCHEMA, WORD, Groups, edge_table, empty_table, prose


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    groups = Groups(fps)
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                groups.join(a, b)
    return {f: groups.find(f) for f in fps}


def clustered(rng, centres, n):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    for _ in range(n):
        v = rng.choice(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            v ^= 1 << rng.choice([rng.randrange(64), rng.randrange(6)])
        out.add(v)
    return out


def test_fingerprints_equal_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "HASHES", 7)
    texts = [None, "", "  ", "One", "one TWO", "É é É é", "a\x0bb\tc  d\ne", prose(300, 3), "x " * 40]
    assert fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert row["h"] % 2**64 == xxh64_intdigest(b"one two three", 42)


def test_gray_rank_orders_neighbours():
    codes = np.array([k ^ (k >> 1) for k in range(300)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(300))


def test_spanning_links_join_what_brute_force_joins():
    rng = random.Random(0)
    for trial in range(40):
        values = np.array(sorted(clustered(rng, rng.choice([1, 3, 20]), rng.choice([1, 5, 50, 300]))), np.uint64)
        values = values[np.argsort(gray_rank(values))].view(np.int64)
        cut = len(values) // 3
        for a, b in ((values, values), (values[:cut], values[cut:])):
            if not len(a):
                continue
            left, right = spanning_links(a, b, 2)
            got, want = Groups([*a.tolist(), *b.tolist()]), Groups([*a.tolist(), *b.tolist()])
            for x, y in zip(left.tolist(), right.tolist()):
                got.join(x, y)
            for x in a.tolist():
                for y in b.tolist():
                    if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                        want.join(x, y)
            assert all(got.find(x) == want.find(x) for x in got.parent)
            assert len(left) < len(a) + len(b)


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(300)] + [(7, 7)]
    groups = Groups({x for p in links for x in p})
    for a, b in links:
        groups.join(a, b)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    found = {r["node"]: r["component"] for r in got}
    assert len(got) == len(found)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: groups.find(x) for x in linked}


def test_links_across_blocks(spark, monkeypatch):
    """Many blocks, several levels, one large group of near copies."""
    monkeypatch.setattr(simhash, "FAN_BITS", 2)
    rng = random.Random(8)
    values = clustered(rng, 1, 700) | clustered(rng, 40, 300)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = simhash.fingerprint_links(table, len(signed), 2, block=8).collect()
    groups = Groups(signed)
    for r in links:
        groups.join(r["a"], r["b"])
    assert {v: groups.find(v) for v in signed} == brute_components(signed)


def test_near_duplicates_equal_brute_force(spark):
    texts = {i: prose(120, i) for i in range(12)}
    rows = [(i, t) for i, t in texts.items()]
    rows += [(100 + i, texts[0]) for i in range(30)] + [(200 + i, texts[1].upper()) for i in range(3)]
    rows += [(300 + i, prose(4000, 50) + f" w{i}") for i in range(12)] + [(400, None), (401, ""), (402, " ")]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    of = brute_components(sorted(set(prints.values())))
    least = {}
    for i, f in prints.items():
        least[of[f]] = min(i, least.get(of[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(table, block=4).collect()}
    assert got == {i: (f"{f:016x}", least[of[f]]) for i, f in prints.items()}
    assert len({c for i, (_, c) in got.items() if i >= 300 and i < 400}) < 12


def test_edges(spark):
    table = edge_table(spark)
    rows = near_duplicates(table).collect()
    assert len(rows) == 11
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert group[1] == group[2] == group[3] == 1
    assert group[None] == group[5] == group[6] == 5
    kept = one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 8, 9]
    alone = spark.createDataFrame([(None, "x y z", None, None, None)], SCHEMA)
    assert one_of_each(alone).count() == 1
    assert near_duplicates(empty_table(spark)).count() == 0
    assert one_of_each(empty_table(spark)).count() == 0


def test_no_unique_text_is_lost_where_ids_clash(spark):
    """One row of each group stays, whatever the ids: shared, missing, or both."""
    t, u, v = (prose(60, i) for i in (71, 72, 73))
    rows = [(1, t), (2, t), (2, u), (3, v), (3, v), (None, v), (None, u + " x"), (None, t), (4, None), (4, ""), (None, "k l m n"), (None, "k l m n")]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame([(*r, i) for i, r in enumerate(order)], "doc_id bigint, text string, fp int").repartition(3)
        kept = [(r["doc_id"], r["text"]) for r in one_of_each(table).collect()]
        prints = {x: brute_fingerprint(x) for _, x in rows}
        of = brute_components(sorted(set(prints.values())))
        groups = {}
        for i, x in rows:
            groups.setdefault(of[prints[x]], []).append((i is None, i, x))
        assert len(kept) == len(groups)
        for i, x in kept:
            least = min(groups[of[prints[x]]], key=lambda r: (r[0], r[1] or 0))
            assert (i is None, i) == least[:2]
        assert {of[prints[x]] for _, x in kept} == set(groups)
