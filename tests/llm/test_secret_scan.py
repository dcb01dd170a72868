import hashlib
import random
import re

import pyarrow as pa

import __spark_entry__ as entry
from counterfact.llm.secret_scan import Ownership, candidates, secret_scan, written
from tests.llm.cases import SCHEMA, edge_table, empty_table, prose

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_base_equals_brute_force():
    rng = random.Random(3)
    bits = ["token", "TOKEN", "ApiKey", "api_key", "secret", "é", " ", "=", ":", '"', "'", "AKIA", "ABCD1234EFGH", "🙂",
            "deadbeef0123456789abcdef", "0" * 33, "\n", "x", "password", "-", ".", "+", "ſecret", "toKen", "passwd"]
    texts = [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]]
    for text, found in zip(texts, candidates(pa.array(texts), Ownership())):
        assert [(s, k, e) for s, k, e, _ in found if k < 3] == brute(text), text
        assert all(text[s:e] == v for s, k, e, v in found if k)


def table_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in rows], SCHEMA)


def test_ownership_parts_examples_from_live_values(spark):
    live, copied = "k9Xv3QmZ7Lr2Tb8Wn5Yc1Hd6", "a1B2c3D4e5F6g7H8i9J0k1L2"
    rows = [(k, f"{prose(5, k)} {copied} token = {'ab' * 10}", f"s{k % 7}") for k in range(400)]
    rows += [(1000, f"é {live} x", "s1"), (1001, f"{live}", "s1"), (1002, "token=Zz9Yy8Xx7", None)]
    got = {r["doc_id"]: r for r in secret_scan(table_of(spark, rows)).collect()}
    assert got[1000]["spans"] == f"generic:2:{2 + len(live)}" and got[1000]["n_live"] == 1
    assert got[1001]["spans"] == f"generic:0:{len(live)}"
    assert got[1002]["n_assign"] == 1 and got[1002]["n_live"] == 1
    assert all("generic" not in got[k]["spans"] and got[k]["n_assign"] == 1 and got[k]["n_copied"] == 1 for k in range(400))


def test_copies_do_not_take_a_key_from_its_owner(spark):
    mine, near, mirrored, partly, shared = (f"{x}9Xv3QmZ7Lr2Tb8Wn5Yc1Hd6" for x in "abcde")
    rows = [(k, f"key {mine}", "s1") for k in range(50)]
    rows += [(100 + k, f"{prose(6, k)} {near}", "s2") for k in range(50)]
    rows += [(200 + k, f"see {mirrored}", f"s{k}") for k in range(5)]
    rows += [(250, f"x {partly}", "s5"), (251, f"y {partly}", "s5"), (252, f"x {partly}", "s1")]
    rows += [(300 + k, f"{prose(4, 500 + k)} {shared}", f"s{k}") for k in range(3)]
    got = {r["doc_id"]: r for r in secret_scan(table_of(spark, rows)).collect()}
    assert all(r["n_live"] == (k < 300) and ("generic" in r["spans"]) == (k < 300) for k, r in got.items())


def test_owners_are_judged_by_their_share(spark):
    """One text of another owner takes no key from its owner; a large owner needs more to stand out."""
    mine, moved, pair, hot, spread = (f"{x}9Xv3QmZ7Lr2Tb8Wn5Yc1Hd6" for x in "abcde")
    rows = [(k, f"{prose(5, k)} {mine}", "s1") for k in range(10)]
    rows += [(20 + k, f"{prose(5, 20 + k)} {moved}", f"s{2 if k else 3}") for k in range(10)]
    rows += [(40, f"{prose(5, 40)} {pair}", "s4"), (41, f"{prose(5, 41)} {pair}", "s5")]
    # Two thirds of a widely copied value lie with the source that has most of all rows.
    rows += [(60 + k, f"{prose(5, 60 + k)} {hot}", "big" if k < 20 else f"s{k}") for k in range(30)]
    rows += [(100 + k, f"{prose(5, 100 + k)} {spread}", f"s{k % 9}") for k in range(27)]
    rows += [(1000 + k, prose(8, 1000 + k), "big") for k in range(150)]
    got = {r["doc_id"]: r["n_live"] for r in secret_scan(table_of(spark, rows)).collect()}
    assert all(n == (k < 60) for k, n in got.items() if k < 1000)
    # Without the other rows of that source, it stands out.
    got = {r["doc_id"]: r["n_live"] for r in secret_scan(table_of(spark, [r for r in rows if r[0] < 1000])).collect()}
    assert all(got[60 + k] == 1 for k in range(30)) and not any(got[100 + k] for k in range(27))


def test_query(spark):
    rows = entry.queries()["op10_secrets"](spark, entry.ENTRY_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{entry.ENTRY_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert {written([s]) for s in base} <= set(r["spans"].split(","))


def test_edges(spark):
    rows = secret_scan(edge_table(spark)).collect()
    assert len(rows) == 11 and all(r["spans"] == "" and r["n_live"] == 0 for r in rows)
    assert secret_scan(empty_table(spark)).count() == 0
    twice = table_of(spark, [(None, "token=abcdefgh1", None)] * 2)
    assert [(r["n_assign"], r["n_live"]) for r in secret_scan(twice).collect()] == [(1, 1), (1, 1)]
