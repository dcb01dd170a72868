import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.draws import digest
from counterfact.operators import environments as envs
from counterfact.operators import masking, packing, schedule, vocab
from counterfact.operators.index import ranged_index, shuffled_index, sorted_index
from counterfact.staging import stage


@pytest.fixture(scope="module")
def numbers(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("env"), F.col("id").alias("doc_id"), F.lit(0).alias("line_no")
    )
    return rows.withColumn("h", digest(7, F.col("doc_id")))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_indexes_equal_one_global_number(numbers, buckets):
    by_hash = Window.partitionBy("env").orderBy("h")
    by_key = Window.partitionBy("env").orderBy("doc_id")
    want = {(r.doc_id, r.i) for r in numbers.withColumn("i", F.row_number().over(by_hash) - 1).collect()}
    assert {(r.doc_id, r.idx) for r in shuffled_index(numbers, ["env"], "h", ["doc_id"], buckets).collect()} == want
    want = {(r.doc_id, r.i) for r in numbers.withColumn("i", F.row_number().over(by_key) - 1).collect()}
    assert {(r.doc_id, r.idx) for r in ranged_index(numbers, ["env"], ["doc_id"], buckets * 500_000).collect()} == want
    keyed = numbers.withColumn("key", F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    assert {(r.doc_id, r.idx) for r in ranged_index(keyed, ["env"], ["key"], buckets * 500_000).collect()} == want


def test_one_document_spans_several_buckets(spark):
    lines = spark.range(900).select(F.lit(7).alias("doc_id"), F.col("id").cast("int").alias("line_no"))
    got = ranged_index(lines, [], ["doc_id", "line_no"], 9 * 500_000).collect()
    assert all(r.idx == r.line_no for r in got) and len(got) == 900


def test_sorted_index(numbers):
    ties = numbers.select((F.col("doc_id") % 5).alias("n"), F.col("h").alias("token"))
    order = [F.desc("n"), F.asc("token")]
    got = {(r.token, r.idx) for r in sorted_index(ties, order).collect()}
    want = {(r.token, r.i) for r in ties.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [0, 1, 2, vocab.FREQUENT_WORDS])
def test_vocabulary_and_encoding(lines_of, monkeypatch, frequent):
    monkeypatch.setattr(vocab, "FREQUENT_WORDS", frequent)
    lines = lines_of(["b a a", "c b a", "!"])
    full = {r.token: r.token_id for r in vocab.build_vocab(lines).collect()}
    assert [full[t] for t in fixed.SPECIAL_TOKENS] == [0, 1, 2, 3, 4]
    assert (full["a"], full["b"], full["c"]) == (5, 6, 7)
    keys = ("doc_id", "line_no")
    ids = {r.doc_id: r.ids for r in vocab.encode_tokens(lines, vocab.build_vocab(lines), keys).collect()}
    assert ids == {0: [2, 6, 5, 5, 3], 1: [2, 7, 6, 5, 3], 2: [2, 3]}
    other = lines_of(["a z c", "b y"])
    ids = {r.doc_id: r.ids for r in vocab.encode_tokens(other, vocab.build_vocab(lines), keys).collect()}
    assert ids == {0: [2, 5, 1, 7, 3], 1: [2, 6, 1, 3]}


@pytest.mark.parametrize("frequent, tokens", [(1, 500_000), (2, 3), (50_000, 3)])
def test_repeated_and_null_lines_are_encoded(spark, monkeypatch, frequent, tokens):
    """Keys need not be unique, whichever way the words are looked up, and other columns are free to be named."""
    monkeypatch.setattr(vocab, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(vocab, "TOKENS_PER_PART", tokens)
    rows = [(1, "c b a", 7)] * 5 + [(1, "d c b a e f", 7), (None, "e d", 8), (2, None, 9), (3, "", 9), (4, "z", 9)]
    lines = spark.createDataFrame(rows, "k int, line string, token int").repartition(3)
    words = vocab.build_vocab(lines.where("line IS NULL OR line <> 'z'"))
    ids = {r.token: r.token_id for r in words.collect()}
    got = vocab.encode_tokens(lines, words, ("k", "token")).collect()
    want = [(k, t, [2, *(ids.get(w, 1) for w in (line or "").split()), 3]) for k, line, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_lines_are_taken_apart_once(spark, lines_of, monkeypatch):
    """The dictionary of a part and its ids come from the same exchange."""
    monkeypatch.setattr(vocab, "FREQUENT_WORDS", 1)
    lines = lines_of(["b a a", "c b a"])
    encoded = vocab.encode_tokens(lines, vocab.build_vocab(lines), ("doc_id",))
    execution = encoded._jdf.queryExecution()
    encoded._jdf.collectToPython()
    plan = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize(
    "lines, rows, blocks, dropped",
    [
        ([[1, 2, 3], [4, 5], [6, 7, 8, 9, 10]], 1000, [[1, 2, 3, 4], [5, 6, 7, 8]], 2),
        ([[1, 2, 3], [4, 5]], 1, [], 5),
    ],
)
def test_packing(spark, lines, rows, blocks, dropped):
    encoded = spark.createDataFrame([("A", i, x) for i, x in enumerate(lines)], "env string, idx bigint, ids array<int>")
    got = packing.pack_blocks(encoded, 4, rows).orderBy("batch_id", "block_id").collect()
    assert [r.input_ids for r in got] == blocks
    report = packing.packing_report(encoded, 4, rows).agg(F.sum("n_dropped"), F.sum("n_blocks")).first()
    assert tuple(report) == (dropped, len(blocks))


def test_masking(spark):
    ids = [2] + list(range(5, 1005)) + [3]
    blocks = spark.createDataFrame([(k, ids) for k in range(20)], "k int, input_ids array<int>")
    rows = masking.mlm_mask(blocks, 3, 2000, ("k",)).collect()
    chosen = masked = kept = 0
    for row in rows:
        assert row.labels[0] == row.labels[-1] == fixed.IGNORED_LABEL
        for before, after, label in zip(ids, row.input_ids, row.labels):
            if label == fixed.IGNORED_LABEL:
                assert before == after
            else:
                assert label == before
                chosen += 1
                masked += after == vocab.MASK_ID
                kept += after == before
    assert chosen / 20000 == pytest.approx(0.15, abs=0.01)
    assert masked / chosen == pytest.approx(0.8, abs=0.03)
    assert kept / chosen == pytest.approx(0.1, abs=0.03)


def sizes_of(spark, **sizes):
    return spark.createDataFrame(list(sizes.items()), "env string, n bigint")


def test_round_plan(spark):
    row = schedule.round_plan(sizes_of(spark, A=100, B=70), nb_steps=5).first()
    assert (row.rounds, row.steps_per_epoch, row.epochs, row.max_steps) == (1, 2, 3, 5)
    row = schedule.round_plan(sizes_of(spark, A=100, B=70), nb_steps=None, num_epochs=4).first()
    assert (row.epochs, row.max_steps) == (4, 8)
    with pytest.raises(ValueError):
        schedule.plan_row(schedule.round_plan(sizes_of(spark, A=100, B=3)))
    with pytest.raises(ValueError):
        schedule.round_plan(sizes_of(spark, A=1), nb_steps=None)


def test_config_check(spark):
    sizes = sizes_of(spark, A=3, B=0)
    assert schedule.run_config_check(["A", "B"], sizes, nb_steps=1).count() == 2
    for names, kwargs in ((["A"], {}), ([], {"nb_steps": 1}), (["B"], {"nb_steps": 1})):
        with pytest.raises(ValueError):
            schedule.run_config_check(names, sizes, **kwargs)


@pytest.fixture(scope="module")
def examples(spark):
    rows = [("A", i, 0) for i in range(100)] + [("B", i, 0) for i in range(100, 170)]
    return spark.createDataFrame(rows, "env string, doc_id bigint, line_no int")


def test_round_robin(examples):
    steps = schedule.round_robin_schedule(examples, envs.env_sizes(examples), 0, nb_steps=3, accumulation=2)
    per_step = {(r.step, r["round"], r.env): r.n for r in steps.groupBy("step", "round", "env").agg(F.count("*").alias("n")).collect()}
    assert per_step == {(1, 0, "A"): 16, (2, 0, "B"): 16, (3, 1, "A"): 16}


def test_empty_environment_has_no_turn(spark, examples):
    sizes = envs.env_sizes(examples, ["A", "B", "C"])
    steps = schedule.round_robin_schedule(examples, sizes, 0, nb_steps=100, accumulation=1)
    assert sorted(r.step for r in steps.select("step").distinct().collect()) == list(range(1, 101))
    only = examples.where("env = 'A'")
    steps = schedule.round_robin_schedule(only, envs.env_sizes(only, ["A", "B"]), 0, nb_steps=100, accumulation=1)
    assert sorted(r.step for r in steps.select("step").distinct().collect()) == list(range(1, 101))


def test_schedule_steps_have_no_gaps(examples):
    steps = schedule.round_robin_schedule(examples, envs.env_sizes(examples), 0, nb_steps=11, accumulation=1)
    assert sorted(r.step for r in steps.select("step").distinct().collect()) == list(range(1, 12))
    pooled = examples.withColumn("env", F.lit("all_train"))
    steps = schedule.pooled_schedule(pooled, envs.env_sizes(pooled), 0, nb_steps=25, accumulation=1)
    assert sorted(r.step for r in steps.select("step").distinct().collect()) == list(range(1, 26))
    assert steps.where("epoch = 0").select("doc_id").distinct().count() == 170


def by_definition(examples, epochs, batches, last):
    """First batches out of the whole order of every epoch."""
    drawn = schedule.shuffled_batches(examples, 0, examples.count(), epochs)
    needed = F.when(F.col("epoch") == epochs - 1, last).otherwise(batches)
    return {tuple(r) for r in drawn.where(F.col("batch_no") < needed).select("epoch", "env", "doc_id", "idx", "batch_no").collect()}


@pytest.mark.parametrize("larger", [1, 0.2, 50, 4_000])
def test_first_batches_equal_the_whole_order(examples, larger):
    """Also where the sizes are wrong, so that the first cut is too narrow or too wide."""
    sizes = envs.env_sizes(examples).withColumn("n", F.ceil(F.col("n") * larger).cast("bigint"))
    if larger < 1:
        sizes = sizes.withColumn("n", F.greatest("n", F.lit(32)))
    got = schedule.first_batches(examples, sizes, 0, 3, 2, 1)
    assert {tuple(r) for r in got.select("epoch", "env", "doc_id", "idx", "batch_no").collect()} == by_definition(examples, 3, 2, 1)


def test_a_short_environment_has_all_its_examples(examples):
    got = schedule.first_batches(examples, envs.env_sizes(examples), 0, 2, 5, 7)
    assert {tuple(r) for r in got.select("epoch", "env", "doc_id", "idx", "batch_no").collect()} == by_definition(examples, 2, 5, 7)


def test_a_small_environment_does_not_multiply_what_is_moved(spark, monkeypatch):
    """Many epochs over a large environment move the examples of the steps, not all in every epoch."""
    rows = spark.range(20_000).select(F.lit("large").alias("env"), F.col("id").alias("doc_id"), F.lit(0).alias("line_no"))
    few = spark.range(16).select(F.lit("small").alias("env"), (F.col("id") + 20_000).alias("doc_id"), F.lit(0).alias("line_no"))
    both, moved = rows.unionByName(few), []

    def staged(df, label):
        out = stage(df, label)
        moved.append((label, out.count()))
        return out

    monkeypatch.setattr(schedule, "stage", staged)
    steps = schedule.round_robin_schedule(both, envs.env_sizes(both), 0, nb_steps=60, accumulation=1)
    assert steps.count() == 60 * 16 and steps.agg(F.max("epoch")).first()[0] == 29
    assert sum(n for label, n in moved if label == "drawn") < 4 * 60 * 16


def test_thousands_of_environments(spark, monkeypatch):
    monkeypatch.setattr(schedule, "FEW_ENVS", 100)
    rows = spark.range(12_000).select(
        F.concat(F.lit("e"), F.lpad((F.col("id") % 3_000).cast("string"), 4, "0")).alias("env"),
        F.col("id").alias("doc_id"), F.lit(0).alias("line_no"),
    )
    steps = schedule.round_robin_schedule(rows, envs.env_sizes(rows), 0, nb_steps=7_000, batch_size=2, accumulation=1)
    found = {r.step: (r.epoch, r.env) for r in steps.select("step", "epoch", "env").distinct().collect()}
    assert found == {s + 1: (s // 6_000, f"e{s % 3_000:04d}") for s in range(7_000)}


def test_epochs_are_drawn_anew(examples):
    drawn = schedule.shuffled_batches(examples, 0, 170, epochs=2)
    first, second = ([r.doc_id for r in drawn.where((F.col("env") == "A") & (F.col("epoch") == e)).orderBy("idx").collect()] for e in (0, 1))
    assert sorted(first) == sorted(second) and first != second
    assert drawn.where("env = 'A' AND epoch = 0").agg(F.max("batch_no")).first()[0] == 6


def test_log_and_checkpoint_steps(spark):
    steps = spark.range(1, 1301).select(F.lit(0).alias("epoch"), F.col("id").alias("step"))
    assert {r.step for r in schedule.log_steps(steps, n_env=3).collect()} == {600, 1200}
    cut = steps.where("step <= 200")
    assert {r.step for r in schedule.log_steps(cut, n_env=3, max_steps=200).collect()} == {200}
    assert {r.step for r in schedule.checkpoint_steps(steps, 500).collect()} == {500, 1000}
    assert schedule.checkpoint_steps(steps, 0).isEmpty()


def test_rank_shards(examples):
    ranked = schedule.rank_shards(schedule.shuffled_batches(examples, 0, 170), 4)
    assert {r.rank: r.n for r in ranked.where("env = 'A'").groupBy("rank").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 25)
