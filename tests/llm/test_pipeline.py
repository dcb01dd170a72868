import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from counterfact.llm.pii import find_spans, fit, redacted
from counterfact.llm.quality_rules import Limits
from counterfact.llm.queries import tokenizer_path
from tests.llm.cases import SCHEMA, edge_rows, edge_table, empty_table
from tests.llm.test_decontamination import smith_waterman, words
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_simhash import brute_components, brute_fingerprint

KEPT = 6  # place of the verdict among the measures


def brute(docs, items):
    """What should reach the tagger: rows (id, text)."""
    docs = [(k, t) for k, t in docs if brute_quality(t, Limits())[KEPT]]
    prints = {k: brute_fingerprint(t) for k, t in docs}
    of = brute_components(sorted(set(prints.values())))
    least = {}
    for k in sorted(prints):
        least.setdefault(of[prints[k]], k)
    docs = [(k, t) for k, t in docs if least[of[prints[k]]] == k]

    def clean(text):
        seen = words(text)
        share = [smith_waterman(seen, i) / (2 * len(i)) for i in items if set(i) & set(seen)]
        return max(share, default=0) < 0.4

    return [(k, t) for k, t in docs if clean(t)]


def test_stage_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact", "tokenize"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_pipeline_equals_brute_force(spark, tmp_path):
    source = spark.read.parquet(f"{entry.ENTRY_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{entry.ENTRY_DIR}/benchmark.parquet")
    rows = [r for r in source.collect() if len(r["text"]) < 3000]
    rows += [r for r in rows[:5]]
    data = spark.createDataFrame(rows, source.schema)
    data.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = {r["doc_id"]: r["text"] for r in rows}
    want = brute(list(docs.items()), [words(r["text"]) for r in bench.collect()])
    assert 0 < len(want) < len(docs)

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:3]:
        before, table = table, step(spark, table, str(tmp_path))
        assert table.columns == before.columns
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"]: r["text"] for r in table.collect()}
    assert table.count() == len(left) and left == dict(want)

    found = find_spans(list(left.values()), fit(table))
    clean = {k: redacted(t, spans) for (k, t), (_, spans) in zip(left.items(), found)}
    library = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(clean) and len(got) == len(clean)
    for r in got:
        ids = library.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["n_chars"] == len(clean[r["doc_id"]])


@pytest.mark.parametrize("make", [edge_table, empty_table])
def test_each_stage_handles_edges(spark, make):
    table = make(spark)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, table, entry.ENTRY_DIR)
        if name != "tokenize":
            assert out.columns == table.columns, name
        n = {"quality": 5, "near_dedup": 6, "decontaminate": 11, "redact": 11, "tokenize": 11}[name]
        assert out.count() == (n if make is edge_table else 0), name


def test_rows_without_an_id_pass(spark):
    table = spark.createDataFrame([(None, *r[1:]) for r in edge_rows()], SCHEMA)
    assert corpus_pipeline.quality(spark, table, entry.ENTRY_DIR).count() > 0
    assert corpus_pipeline.near_dedup(spark, table, entry.ENTRY_DIR).count() == 6


def test_carried_columns_survive_every_stage(spark):
    """Columns with the names of computed ones keep their values."""
    rows = [(r[0], r[1], i, f"n{i}", f"d{i}", i) for i, r in enumerate(edge_rows())]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, n_tokens string, decoded string, _kept int")
    own = ["ids", "n_tokens", "decoded", "_kept"]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, table, entry.ENTRY_DIR)
        got = {tuple(r) for r in out.select(*own).collect()}
        assert got and got <= {(i, f"n{i}", f"d{i}", i) for i in range(len(rows))}, name
    assert sorted(out.columns) == sorted(["doc_id", *own, "n_tokens_", "ids_"])
    library = Tokenizer.from_file(tokenizer_path())
    for r in out.collect():
        ids = library.encode(rows[r["ids"]][1] or "", add_special_tokens=False).ids
        assert bytes(r["ids_"]) == np.array(ids, "<u4").tobytes() and r["n_tokens_"] == len(ids)
