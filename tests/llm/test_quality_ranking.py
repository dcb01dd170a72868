import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from counterfact.llm.quality_ranking import THRESHOLD, Ranking, Training, fit, held_out, learn, rank_quality, vectors
from tests.llm.cases import edge_table, empty_table

DATA = "/root/testdata/sf0.01"


def test_pairs_recover_a_ranking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    truth = x @ np.array([2.0, -1.0, 0.5, 0.0])
    label = (truth + rng.normal(0, 0.2, 600) > -1.5).astype(int)
    ranking = learn(x, label, Training(pairs=5000))
    assert np.corrcoef(ranking.raw(x), truth)[0, 1] > 0.95
    score = ranking.score(x)
    assert ((score >= THRESHOLD) == label).mean() > 0.93
    order = np.argsort(ranking.raw(x))
    assert (np.diff(score[order]) >= 0).all() and score.min() >= 0 and score.max() <= 1


def test_held_out_accuracy(spark):
    got = entry.queries()["op4_quality_ranking"](spark, DATA)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 1000
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.97


def test_edges(spark):
    table = edge_table(spark)
    labels = spark.createDataFrame(
        [(4, 1), (4, 1), (9, 0), (5, None), (6, 7), (None, 1), (8, 0), (5, 1)], "doc_id bigint, quality int"
    )
    ranking = fit(table, labels, ~held_out() | held_out())
    out = rank_quality(table, ranking).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    nothing = fit(table, labels.where("quality = 1"), ~held_out())
    assert {r["score"] for r in rank_quality(table, nothing).collect()} == {1.0}
    assert isinstance(fit(empty_table(spark), labels, ~held_out()), Ranking)
    assert rank_quality(empty_table(spark), ranking).count() == 0
    assert vectors(pa.array([None, ""], pa.string())).shape[0] == 2


def test_measures_of_a_text_do_not_depend_on_its_neighbours():
    """The same vector alone, first, last and between any others."""
    long = "x" * 100
    texts = ["one two three", f"a {long}", "", None, f"{long} b", long, "  ", f"one {long} two\n{long}", "Écoutez, 日本語!", "word " * 90]
    alone = {t: vectors(pa.array([t], pa.string()))[0] for t in texts}
    rng = np.random.default_rng(3)
    for _ in range(20):
        order = rng.permutation(len(texts))
        got = vectors(pa.array([texts[i] for i in order], pa.string()))
        assert all((got[at] == alone[texts[i]]).all() for at, i in enumerate(order))
    assert alone[long][11] == alone[f"a {long}"][11] * 2 == 1.0 and alone["one two three"][11] == 0


def test_scores_do_not_depend_on_partitions(spark):
    """Also where words of over 64 bytes decide the labels."""
    rows = [(i, ("w" * 80 + " tail " if i % 2 else "plain words here ") * (1 + i % 5)) for i in range(200)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)], "doc_id bigint, quality int")
    found = []
    for n in (1, 4, 37):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        ranking = fit(docs, labels, ~held_out())
        found.append({(r["doc_id"], r["score"], r["predicted"]) for r in rank_quality(docs, ranking, carry=["doc_id"]).collect()})
    assert found[0] == found[1] == found[2] and len({s for _, s, _ in found[0]}) > 1


def _spaced(n):
    """Words whose share of marks tells the label; the number of the text is in its length."""
    return [(i, ("word " * (1 + i % 7) + "# $ " * (i % 2)) * 3, (i + 1) % 2) for i in range(n)]


def test_every_labelled_text_is_learned_from(spark):
    """Also beyond 8,000 texts of a label, where a sample was taken: all moments are those of the whole table."""
    from counterfact.llm import quality_ranking as q

    rows = _spaced(20000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    ranking = fit(docs, labels, F.lit(True))
    x = vectors(pa.array([t for _, t, _ in rows]))
    assert np.allclose(ranking.mean, x.mean(0), rtol=1e-9, atol=1e-9) and np.allclose(ranking.scale, x.std(0) + 1e-9, rtol=1e-6, atol=1e-6)
    one = q.rank_measured(q.measured(docs, carry=["doc_id"]), ranking).orderBy("doc_id").collect()
    assert one == rank_quality(docs, ranking, carry=["doc_id"]).orderBy("doc_id").collect()
    assert np.mean([r["predicted"] == y for r, (_, _, y) in zip(one, rows)]) > 0.99


def test_every_text_is_in_a_pair_and_counted_once(spark):
    """With a label that is rare, and with both alike."""
    from counterfact.llm import quality_ranking as q

    for rare in (2, 300, 3000):
        rows = [(i, int(i >= rare), np.array([float(i), 1.0]).tobytes()) for i in range(6000)]
        table = spark.createDataFrame(rows, "id bigint, label int, vector binary")
        found = q._buckets(table, {0: rare, 1: 6000 - rare}, Training(texts=64, mates=4, pairs=1)).collect()
        own = []
        for r in found:
            good, bad = (np.frombuffer(r[c], np.float64).reshape(-1, 2) for c in ("good", "bad"))
            assert len(good) and len(bad)
            own += [*good[: r["own_good"], 0], *bad[: r["own_bad"], 0]]
            bucket = q.Bucket(good, bad, (r["own_good"], r["own_bad"]))
            assert len(bucket.differences(lambda v: v, 1)) == max(len(good), len(bad))
        assert sorted(own) == list(range(6000))
