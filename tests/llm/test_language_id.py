import zlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from counterfact.llm.language_id import BUCKETS, Coder, Training, codewords, features, fit, held_out, identify, learn, with_letter
from tests.llm.cases import edge_table, empty_table

DATA = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for classes in range(2, 12):
        code = codewords(classes, np.random.default_rng(1))
        apart = [(code[a] != code[b]).sum() for a in range(classes) for b in range(a)]
        assert min(apart) >= (2 ** (classes - 2) if classes <= 7 else 5)
        assert set(np.unique(code)) == {-1, 1}


def test_features_equal_counts():
    texts = ["Ab cab", "", None, "é1x"]
    x = features(pa.array(texts))
    plain = [("ab cab" if t == "Ab cab" else "é x" if t else "").encode() for t in texts]
    for row, data in zip(x, plain):
        for order in (1, 2, 3):
            counts = np.zeros(BUCKETS)
            for k in range(len(data) - order + 1):
                gram = 0
                for c in data[k : k + order]:
                    gram = (gram * 257 + c) % 2**32
                counts[(gram * 2654435761 % 2**32) >> 22] += 1
            want = np.sqrt(counts / max(1, counts.sum()))
            assert np.allclose(row[(order - 1) * BUCKETS : order * BUCKETS], want, atol=1e-6)


def test_letters():
    assert with_letter(pa.array(["", "1 2", "é", "日", "a", "🙂 ٣"])).tolist() == [False, False, True, True, True, False]


def test_few_languages():
    x = np.eye(3, BUCKETS, dtype=np.float32)
    assert learn(x[:0], [], Training()).decode(x)[0] == ["und"] * 3
    assert learn(x, ["a"] * 3, Training()).decode(x)[0] == ["a"] * 3
    coder = learn(x, ["a", "b", "c"], Training())
    assert coder.decode(x)[0] == ["a", "b", "c"]
    same = Coder(["a", "b"], np.array([[1], [-1]]), np.zeros((BUCKETS, 1)), np.zeros(1), 0.1)
    assert same.decode(x)[2].all()  # nothing parts the two: ambiguous


def test_held_out_accuracy(spark):
    rows = entry.queries()["op6_language_id"](spark, DATA).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.98


def test_edges(spark):
    table = edge_table(spark)
    coder = fit(table, ~held_out() | held_out())
    assert coder.languages == ["en", "fr"]
    rows = {r["doc_id"]: r for r in identify(table, coder).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[4]["lang_pred"] in ("en", "fr") and rows[None]["lang_pred"] in ("en", "fr")
    assert identify(empty_table(spark), coder).count() == 0
    assert fit(empty_table(spark), ~held_out()).languages == []
