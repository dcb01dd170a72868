import gzip
import random

import pytest
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.operators import environments as envs
from counterfact.operators.dictionary import TermDictionary
from counterfact.plans import summary
from counterfact.sinks import writers
from counterfact.sources import corpus, scores
from registry.queries import QUERIES

TERMS = TermDictionary([("he", "she")])


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_plain_folder(spark, tmp_path):
    for name, text in {"env_A.txt": "a\nb\n", "env_B.x.txt": "c\n", "all_train.txt": "d\n", "notes.md": "e\n", "void.txt": ""}.items():
        write(tmp_path / name, text)
    assert {tuple(r) for r in corpus.env_folder_scan(spark, str(tmp_path)).collect()} == {("env_A", "a"), ("env_A", "b"), ("env_B", "c")}
    got = {tuple(r) for r in corpus.nonempty_eval_scan(spark, str(tmp_path)).collect()}
    assert ("env_A", "a") in got and not any(s == "void" for s, _ in got)
    report = corpus.skipped_eval_files(spark, str(tmp_path), ["env_A", "gone"]).collect()
    assert {tuple(r) for r in report} == {("void", "empty"), ("gone", "missing")}
    assert {tuple(r) for r in corpus.single_file_env(spark, str(tmp_path / "env_A.txt")).collect()} == {("all_train", "a"), ("all_train", "b")}


def test_split_selection(spark):
    rows = spark.createDataFrame([("val_ind", "a"), ("test", "b")], "split string, line string")
    assert corpus.eval_split_select(rows, "ind").first().line == "a"
    with pytest.raises(ValueError):
        corpus.eval_split_select(rows, "ood")


def test_text_export_round_trip(spark, lines_of, tmp_path):
    lines = lines_of([f"he is {i:02d}" for i in range(50)], 3)
    cells = envs.grid_assign(lines, TERMS, (0, 1), ("0.25", "0.5"))
    names = spark.createDataFrame([(s, p) for s in (0, 1) for p in ("0.25", "0.5")], "seed int, p_text string")
    rows = writers.split_files(cells, lines_of(["v"]), lines_of(["t"]), names)
    folder = str(tmp_path / "splits")
    for _ in range(2):  # a second export replaces the first
        writers.export_split_text(rows, folder)
    cell = f"{folder}/seed=1/p_env_a=0.5"
    one = envs.env_assign(lines, TERMS, 1, 0.5).collect()

    def read(name):
        parts = sorted((tmp_path / "splits" / "seed=1" / "p_env_a=0.5" / f"file={name}").glob("part-*"))
        return [x for p in parts for x in p.read_text().splitlines()]

    by_env = {e: [r.line for r in sorted(one, key=lambda r: r.doc_id) if r.env == e] for e in (fixed.ENV_A, fixed.ENV_B)}
    assert {e: read(e) for e in by_env} == by_env
    assert read(fixed.POOLED_ENV) == by_env[fixed.ENV_A] + by_env[fixed.ENV_B]
    assert (read("val_ind"), read("test")) == (["v"], ["t"])
    assert spark.read.text(cell).count() == 102


def test_cells_are_exported_in_order(spark, lines_of, tmp_path, monkeypatch):
    """The same files as from rows for every cell, with several ranges and several files for each."""
    monkeypatch.setattr("counterfact.operators.index.ROWS_PERBUCKET", 40)
    lines = lines_of([f"he is {i:03d}" for i in range(100)], 7)
    held = lines_of([f"v {i:02d}" for i in range(30)], 3), lines_of(["t", "u"])
    names = spark.createDataFrame([(s, p) for s in (0, 1) for p in ("0.25", "0.5")], "seed int, p_text string")
    cells = envs.grid_assign(lines, TERMS, (0, 1), ("0.25", "0.5"))
    writers.export_split_text(writers.split_files(cells, *held, names), str(tmp_path / "rows"))
    writers.export_cell_text(lines, TERMS, (0, 1), ("0.25", "0.5"), *held, str(tmp_path / "cells"))

    def texts(name):
        found = {}
        for part in sorted((tmp_path / name).glob("seed=*/*/*/part-*"), key=lambda p: p.name):
            found.setdefault(str(part.parent.relative_to(tmp_path / name)), []).append(part.read_text())
        return found

    got, want = texts("cells"), texts("rows")
    assert {k: "".join(v) for k, v in got.items()} == {k: "".join(v) for k, v in want.items()}
    assert len(got) == 4 * 5 and max(map(len, got.values())) > 10


def test_exported_text_is_packed(spark, lines_of, tmp_path, monkeypatch):
    """Packed files hold the lines of the plain ones in the same order, and those of the query take about half the room."""
    monkeypatch.setattr("counterfact.operators.index.ROWS_PERBUCKET", 200)
    lines, held = lines_of([f"he is {i:03d}" for i in range(100)], 7), lines_of([f"v {i:02d}" for i in range(30)], 3)
    for kind in ("none", "gzip"):
        writers.export_cell_text(lines, TERMS, (0, 1), ("0.25", "0.5"), held, held, str(tmp_path / kind), kind)

    def texts(kind):
        found = {}
        for part in sorted((tmp_path / kind).glob("seed=*/*/*/part-*"), key=lambda p: p.name):
            packed = part.read_bytes()
            text = gzip.decompress(packed) if kind == "gzip" else packed
            name = str(part.parent.relative_to(tmp_path / kind))
            found[name] = found.get(name, b"") + text
        return found

    assert texts("gzip") == texts("none") and len(texts("none")) == 4 * 5

    digits = random.Random(0)
    rows = [(i, 0, "\n".join(f"he is {digits.getrandbits(1200):x}" for _ in range(3))) for i in range(100)]
    for table, names in {"documents": "doc_id", "benchmark": "item_id", "conversations": "conv_id"}.items():
        frame = spark.createDataFrame(rows, f"{names} bigint, turn int, text string")
        frame.write.parquet(str(tmp_path / "in" / f"{table}.parquet"))
    monkeypatch.setattr("registry.queries.new_folder", lambda spark, label: str(tmp_path / label))
    got = QUERIES["export_splits"](spark, str(tmp_path / "in")).collect()
    assert len(got) == 4 * 5 and sum(r.n_lines for r in got) == 4 * 4 * 300
    size = sum(f.stat().st_size for f in (tmp_path / "split_text").rglob("part-*"))
    assert size < 0.65 * sum(r.n_chars for r in got)


def test_names_with_special_characters(spark, tmp_path):
    for name in ("env A", "100% +é", "plain"):
        write(tmp_path / f"{name}.txt", "x\n")
    assert {r.env for r in corpus.env_folder_scan(spark, str(tmp_path)).collect()} == {"env A", "100% +é", "plain"}
    assert {r.split for r in corpus.nonempty_eval_scan(spark, str(tmp_path)).collect()} == {"env A", "100% +é", "plain"}
    assert corpus.skipped_eval_files(spark, str(tmp_path), ["env A"]).isEmpty()


def test_write_splits(spark, lines_of, tmp_path):
    cells = envs.grid_assign(lines_of([f"he is {i}" for i in range(50)]), TERMS, (0, 1), ("0.25", "0.5"))
    writers.write_splits(cells, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.groupBy("seed", "p_env_a").count().where("count = 50").count() == 4
    assert (tmp_path / "s" / "seed=0" / "p_env_a=0.25" / f"env={fixed.ENV_A}").is_dir()


def test_scores(spark, tmp_path):
    folder = tmp_path / "scores"
    write(folder / "split0_p01_lr1e-05_eLM.csv", "bias\n0.5\n0.25\n")
    write(folder / "split2_p09_iLM.csv", "bias\n1.0\n")
    write(folder / "junk.csv", "bias\n9.0\n")
    got = sorted(tuple(r) for r in scores.union_scores(spark, str(folder)).collect())
    assert got == [(0, 0.1, 1e-5, "eLM", 0.25), (0, 0.1, 1e-5, "eLM", 0.5), (2, 0.9, 1e-5, "iLM", 1.0)]
    assert [r.name for r in scores.ignored_score_files(spark, str(folder)).collect()] == ["junk.csv"]
    rows = [(3, "0.25", "0.1", "iLM", "d", 0, 0.75), (3, "0.25", "0.1", "eLM", "d", 0, 0.5)]
    frame = spark.createDataFrame(
        rows, "seed int, p_text string, alpha_text string, method string, doc_id string, line_no int, bias double"
    )
    for _ in range(2):  # a second export replaces the first, other runs stay
        writers.export_scores_csv(frame, str(folder))
    assert scores.scores_scan(spark, str(folder)).count() == 5
    found = scores.scores_scan(spark, str(folder)).where("seed = 3").collect()
    assert {tuple(r) for r in found} == {(3, 0.25, 0.1, "iLM", 0.75), (3, 0.25, 0.1, "eLM", 0.5)}
    writers.write_scores(frame, str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).count() == 2
    write(tmp_path / "none" / "junk.csv", "bias\n9.0\n")
    with pytest.raises(ValueError):
        scores.union_scores(spark, str(tmp_path / "none"))


def test_logs(spark, tmp_path):
    schema = "run string, epoch int, global_step bigint, train_loss double, val_loss double, perplexity double"
    path = str(tmp_path / "log")
    writers.write_training_log(spark.createDataFrame([("a", 1, 200, 1.23456, None, None), ("b", 1, 200, 2.0, 1.0, 2.718281)], schema), path)
    writers.write_training_log(spark.createDataFrame([("b", 1, 400, 3.0, 1.0, 2.718281)], schema), path)
    got = spark.read.option("header", True).csv(path).select("run", "global_step", "train_loss", "val_loss", "perplexity")
    assert {tuple(r) for r in got.collect()} == {("a", "200", "1.2346", None, None), ("b", "400", "3.0000", "1.0000", "2.7183")}

    log = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)], "epoch int, env string, loss double")
    writers.write_loss_history(log, ["A", "B"], str(tmp_path / "history"))
    assert [r.value for r in spark.read.text(str(tmp_path / "history")).collect()] == ["Epoch,A,B", "2,1.0,2.0", "3,3.0,"]

    results = spark.createDataFrame([("perplexity", 2.5), ("eval_loss", 1.5)], "key string, value double")
    writers.write_eval_results(results, str(tmp_path / "eval"))
    assert [r.value for r in spark.read.text(str(tmp_path / "eval")).collect()] == ["eval_loss = 1.5", "perplexity = 2.5"]


def test_training_logs_of_many_runs_share_files(spark, tmp_path):
    """Files do not grow with the runs; a run that is written again replaces its own rows only, whatever its name."""
    path = str(tmp_path / "log")
    names = [None, " a b ", 'x"y,z', "50%", *[f"run{k}" for k in range(396)]]
    schema = "run string, epoch int, global_step bigint, train_loss double, val_loss double, perplexity double"
    rows = [(n, 1, 200 * s, 0.5, None, None) for n in names for s in (1, 2)]
    writers.write_training_log(spark.createDataFrame(rows, schema).repartition(4), path)
    assert len([f for f in (tmp_path / "log").rglob("*.csv")]) <= 64
    again = [None, 'x"y,z', "run7"]
    writers.write_training_log(spark.createDataFrame([(n, 2, 600, 1.5, 1.0, 2.5) for n in again], schema), path)
    got = spark.read.option("header", True).csv(path).select("run", "epoch", "global_step", "train_loss", "val_loss", "perplexity")
    want = [(n, "1", str(200 * s), "0.5000", None, None) for n in names if n not in again for s in (1, 2)]
    want += [(n, "2", "600", "1.5000", "1.0000", "2.5000") for n in again]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    writers.write_training_log(spark.createDataFrame([], schema), path)
    assert spark.read.option("header", True).csv(path).count() == len(want)


def test_environments_are_written_in_one_job(spark, tmp_path):
    """Any names: blanks, signs that a path escapes, dots (the name ends before the first)."""
    names = ["en", "a b", "a+b", "50%", "x:y=z", "été", "v1.2"]
    rows = spark.createDataFrame([(n, f"line {i}") for i, n in enumerate(names)], "env string, line string")
    writers.write_env_folder(rows, str(tmp_path / "envs"))
    got = corpus.env_folder_scan(spark, str(tmp_path / "envs"))
    assert {tuple(r) for r in got.collect()} == {(n.split(".")[0], f"line {i}") for i, n in enumerate(names)}


def test_completed_runs_have_a_score_file(spark, tmp_path):
    write(tmp_path / "split0_p01_lr1e-05_eLM.csv" / "part-0.csv", "bias\n0.5\n")
    write(tmp_path / "split1_p05_iLM.csv", "bias\n")
    write(tmp_path / "split2_p09.log", "half")
    done = scores.completed_runs(spark, str(tmp_path))
    assert {(r.seed, r.p_env_a, r.method) for r in done.collect()} == {(0, 0.1, "eLM"), (1, 0.5, "iLM")}
    cells = spark.createDataFrame([(0, "eLM"), (1, "eLM"), (1, "iLM")], "seed int, method string")
    left = summary.pending_runs(cells, done, ["seed", "method"]).collect()
    assert [(r.seed, r.method) for r in left] == [(1, "eLM")]


def test_a_broken_export_leaves_its_runs_pending(spark, tmp_path):
    """Also runs that were complete before it began; the others stay complete."""
    folder = str(tmp_path / "scores")
    row = "seed int, p_text string, alpha_text string, method string, bias double"
    cells = [(s, "0.5", "0.1", m, 0.1 * s) for s in range(3) for m in ("eLM", "iLM")]
    writers.export_scores_csv(spark.createDataFrame(cells, row), folder)
    write(tmp_path / "scores" / "split7_p05_eLM.csv", "bias\n0.5\n")

    def done():
        return {(r.seed, r.method) for r in scores.completed_runs(spark, folder).collect()}

    every = {(s, m) for s, *_, m, _ in cells} | {(7, "eLM")}
    assert done() == every and scores.unfinished_files(spark, folder).isEmpty()
    broken = spark.createDataFrame([c for c in cells if c[0] == 1] + [(5, "0.5", "0.1", "eLM", 9.0)], row).repartition(3)
    fails = F.udf(lambda x: 1 / (x - 9.0), "double")
    with pytest.raises(Exception):
        writers.export_scores_csv(broken.withColumn("bias", fails("bias")), folder)
    assert done() == {(0, "eLM"), (0, "iLM"), (2, "eLM"), (2, "iLM"), (7, "eLM")}
    assert scores.union_scores(spark, folder).count() >= 5
    writers.export_scores_csv(broken, folder)
    assert done() == every | {(5, "eLM")}


def test_a_run_begun_again_is_pending_until_it_is_committed(spark, tmp_path):
    folder = str(tmp_path / "scores")
    write(tmp_path / "scores" / "split0_p05_eLM.csv", "bias\n0.5\n")
    marks = [("split0_p05_eLM.csv", a, s, t) for a, s, t in [("x", "begun", 1), ("x", "completed", 2), ("y", "begun", 3)]]
    spark.createDataFrame(marks, scores.MARKS).write.parquet(scores.marks_folder(folder))
    assert scores.completed_runs(spark, folder).isEmpty()
    spark.createDataFrame([(marks[0][0], "y", "completed", 4)], scores.MARKS).write.mode("append").parquet(scores.marks_folder(folder))
    assert scores.completed_runs(spark, folder).count() == 1
