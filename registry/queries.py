"""The registered queries, one per operator, each over the whole tables it reads."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import measures, tags, text
from counterfact.functions.batches import map_batches as _map_batches
from counterfact.functions.batches import masked_scorer as _masked_scorer
from counterfact.functions.batches import count_scorer, place_scorer
from counterfact.operators import dictionary as terms
from counterfact.operators import environments as envs
from counterfact.operators import masking, packing, runlog, schedule, vocab
from counterfact.operators.index import ranged_index
from counterfact.plans import cloze, environments, evaluation, grid, summary
from counterfact.sinks import writers
from counterfact.sources import corpus, scores
from counterfact.staging import new_folder, stage
from registry.settings import (
    ALL_TERMS,
    ALPHA,
    BLOCK,
    CHECKPOINT_EVERY,
    FREQUENT,
    FULL,
    LOG_RUNS_EPOCH,
    ONE_CELL,
    P,
    RANKS,
    SEED,
    SMALL,
)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _env_lines(spark: SparkSession, d: str) -> DataFrame:
    return envs.env_assign(corpus.document_lines(spark, d), FREQUENT, SEED, float(P))


def _lang_lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines with the language as environment."""
    docs = _documents(spark, d).where(F.col("lang").isNotNull())
    return corpus.clean_lines(corpus.table_lines(docs, "doc_id", F.col("lang").alias("env")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Step log: user as run, event type as environment, event number as step, logarithm of the value as loss."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return events.select(
        F.col("user_id").alias("run"),
        F.floor(F.col("event_id") / LOG_RUNS_EPOCH).cast("bigint").alias("epoch"),
        F.floor(F.col("event_id") / 5).cast("bigint").alias("round"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("env"),
        F.log(1 + F.col("value")).alias("loss"),
    )


def _model(spark: SparkSession, d: str, which: grid.Grid, asked: DataFrame) -> grid.GridModel:
    return grid.fit_grid(corpus.document_lines(spark, d), FREQUENT, which, asked=asked)


def _test_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the scored test lines."""
    return cloze.cell_items(corpus.conversation_lines(spark, d), FREQUENT).select("ctx")


def _val_contexts(spark: SparkSession, d: str) -> DataFrame:
    """All contexts of the validation lines."""
    return cloze.line_pairs(corpus.benchmark_lines(spark, d)).select("ctx")


def _line_scores(spark: SparkSession, d: str, which: grid.Grid) -> DataFrame:
    model = _model(spark, d, which, _test_contexts(spark, d))
    return grid.grid_line_bias(model, corpus.conversation_lines(spark, d))


# --- flagship -------------------------------------------------------------------------------------


@query
def bias_cell(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the bias for one cell, pooled and per-environment estimators."""
    out = grid.grid_summary(_model(spark, d, ONE_CELL, _test_contexts(spark, d)), corpus.conversation_lines(spark, d))
    return out.select("p_env_a", "alpha", "method", "n_scored", _r("mean_bias"), _r("std_bias"))


@query
def bias_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same for the whole grid of seeds, p and smoothing values."""
    out = grid.grid_summary(_model(spark, d, FULL, _test_contexts(spark, d)), corpus.conversation_lines(spark, d))
    return out.select("p_env_a", "alpha", "method", "n_scored", _r("mean_bias"), _r("std_bias"))


# --- scans, sources, sinks ------------------------------------------------------------------------


@query
def lines_scan(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table_lines(_documents(spark, d), "doc_id")


@query
def env_folder_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "env_folder")
    env_lines = stage(_env_lines(spark, d), "env_lines")
    for env in (fixed.ENV_A, fixed.ENV_B):
        env_lines.where(F.col("env") == env).select("line").write.text(f"{folder}/{env}.txt")
    env_lines.select("line").write.text(f"{folder}/{fixed.POOLED_ENV}.txt")
    env_lines.select("line").write.text(f"{folder}/notes.md")
    return corpus.env_folder_scan(spark, folder)


@query
def single_file_env(spark: SparkSession, d: str) -> DataFrame:
    path = f"{new_folder(spark, 'pooled')}/{fixed.POOLED_ENV}.txt"
    _env_lines(spark, d).select("line").write.text(path)
    return corpus.single_file_env(spark, path)


@query
def nonempty_eval_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "val_env")
    val, test = corpus.benchmark_lines(spark, d), corpus.conversation_lines(spark, d)
    val.select("line").write.text(f"{folder}/val_ind.txt")
    test.select("line").write.text(f"{folder}/test.txt")
    val.select("line").where(F.col("line") == "").write.text(f"{folder}/val_ood.txt")
    read = corpus.nonempty_eval_scan(spark, folder).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lines"), F.lit("read").alias("status")
    )
    skipped = corpus.skipped_eval_files(spark, folder, ["val_ind", "val_extra"])
    return read.unionByName(
        skipped.select("split", F.lit(0).cast("bigint").alias("n_lines"), F.col("reason").alias("status"))
    )


@query
def eval_split_select(spark: SparkSession, d: str) -> DataFrame:
    return corpus.eval_split_select(corpus.split_corpus(spark, d), "ind")


@query
def test_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return corpus.test_lines_scan(corpus.table_lines(turns, "conv_id", "turn"))


def _exported_scores(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark, "scores")
    line_scores = stage(_line_scores(spark, d, SMALL), "line_scores")
    writers.export_scores_csv(line_scores, folder)
    line_scores.select("bias").write.option("header", True).csv(f"{folder}/notes.csv")
    return folder


@query
def scores_scan(spark: SparkSession, d: str) -> DataFrame:
    found = scores.scores_scan(spark, _exported_scores(spark, d))
    return found.groupBy("seed", "p_env_a", "lr", "method").agg(
        F.count("bias").alias("n_scored"), F.round(F.avg("bias"), 6).alias("mean_bias")
    )


@query
def union_scores(spark: SparkSession, d: str) -> DataFrame:
    found = scores.union_scores(spark, _exported_scores(spark, d))
    return found.select("seed", "p_env_a", "lr", "method", _r("bias"))


@query
def text_column_pick(spark: SparkSession, d: str) -> DataFrame:
    named = _documents(spark, d).select("lang", F.col("text").alias("content"))
    first = spark.read.parquet(f"{d}/benchmark.parquet").select("text", "item_id")
    return (
        corpus.text_column_pick(named)
        .select(F.lit("content").alias("picked"), "text")
        .unionByName(corpus.text_column_pick(first).select(F.lit("first").alias("picked"), "text"))
    )


@query
def write_splits(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the grid written as nested streams, and the sizes of their environments read back."""
    folder = new_folder(spark, "splits")
    lines = corpus.document_lines(spark, d)
    writers.write_streams(envs.nested_streams(lines, FREQUENT, fixed.SEEDS, fixed.P_ENV_A), folder)
    return envs.stream_sizes(corpus.stored_streams(spark, folder), fixed.P_ENV_A)


@query
def export_splits(spark: SparkSession, d: str) -> DataFrame:
    """All text files of the small grid, read back: environments, pooled, validation, test."""
    folder = new_folder(spark, "split_text")
    lines = corpus.document_lines(spark, d)
    held = corpus.benchmark_lines(spark, d), corpus.conversation_lines(spark, d)
    writers.export_cell_text(lines, FREQUENT, SMALL.seeds, SMALL.p_values, *held, folder, "gzip")
    return spark.read.text(folder).groupBy("seed", F.col("p_env_a").cast("double").alias("p_env_a"), "file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
    )


@query
def write_scores(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "scores")
    writers.write_scores(_line_scores(spark, d, SMALL), folder)
    read = spark.read.parquet(folder)
    return read.select(
        "seed",
        F.col("p_env_a").cast("double").alias("p_env_a"),
        F.col("alpha").cast("double").alias("alpha"),
        "method",
        "doc_id",
        "line_no",
        _r("bias"),
    )


@query
def write_training_log(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "training_log")
    log = _events(spark, d)
    val_loss = log.select("run", F.col("step").alias("global_step"), F.col("loss").alias("val_loss"))
    writers.write_training_log(runlog.training_log(log, val_loss), folder)
    return _read_training_log(spark, folder)


def _read_training_log(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .schema("epoch bigint, global_step bigint, train_loss double, val_loss double, perplexity double, run bigint")
        .csv(folder)
        .select("run", "epoch", "global_step", "train_loss", "val_loss", "perplexity")
    )


@query
def write_round_log(spark: SparkSession, d: str) -> DataFrame:
    """Log of per-environment runs, a row at the end of a round of five events."""
    folder = new_folder(spark, "round_log")
    log = _events(spark, d).withColumn("run", F.lit(0).cast("bigint")).withColumn("step", F.col("step") + 1)
    val_loss = log.select("run", F.col("step").alias("global_step"), F.col("loss").alias("val_loss"))
    writers.write_training_log(runlog.round_log(log, val_loss, 10), folder)
    return _read_training_log(spark, folder)


@query
def write_loss_history(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "loss_history")
    log = _events(spark, d)
    names = envs.env_names(log)
    writers.write_loss_history(log, names, folder)
    schema = ", ".join(["Epoch bigint", *[f"`{n}` double" for n in names]])
    return spark.read.option("header", True).schema(schema).csv(folder).select("Epoch", *[_r(n) for n in names])


@query
def write_eval_results(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "eval_results")
    log = _events(spark, d).select(F.col("epoch").alias("batch"), "loss")
    result = runlog.batch_mean_loss(log).select(
        F.round("eval_loss", 6).alias("eval_loss"),
        F.round(measures.perplexity(F.col("eval_loss")), 6).alias("perplexity"),
    )
    pairs = result.select(F.expr("stack(2, 'perplexity', perplexity, 'eval_loss', eval_loss) AS (key, value)"))
    writers.write_eval_results(pairs, folder)
    lines = spark.read.text(folder)
    parts = F.split(F.col("value"), " = ")
    return lines.select(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).cast("double").alias("value"))


# --- projections, filters, scalar functions -------------------------------------------------------


@query
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean_lines(lines_scan(spark, d))


@query
def pair_dictionary(spark: SparkSession, d: str) -> DataFrame:
    counts = vocab.token_counts(corpus.document_lines(spark, d)).withColumnRenamed("token", "term")
    return ALL_TERMS.frame(spark).join(counts, "term", "left").select("term", "opposite", F.coalesce("n", F.lit(0)).alias("n"))


@query
def swap_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.swap_lines(corpus.document_lines(spark, d), ALL_TERMS)


@query
def swap_rate(spark: SparkSession, d: str) -> DataFrame:
    drawn = corpus.document_lines(spark, d).withColumn("env", envs.line_env(SEED, float(P)))
    return terms.swap_rate(drawn.where(F.col("env") == fixed.ENV_B), ALL_TERMS, ("env",))


@query
def env_assign(spark: SparkSession, d: str) -> DataFrame:
    assigned = envs.env_assign(corpus.document_lines(spark, d), ALL_TERMS, SEED, float(P))
    return assigned.select("env", "doc_id", "line_no", "line")


@query
def word_extract(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.document_lines(spark, d)
    return lines.select("doc_id", "line_no", F.array_join(text.words(F.col("line")), " ").alias("words"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return terms.single_hits(corpus.document_lines(spark, d), ALL_TERMS)


@query
def single_hit_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "line_no", "target", "opposite")


@query
def mask_target(spark: SparkSession, d: str) -> DataFrame:
    return terms.mask_hits(_hits(spark, d), ALL_TERMS).select("doc_id", "line_no", "masked")


@query
def first_mask_pos(spark: SparkSession, d: str) -> DataFrame:
    return terms.mask_hits(_hits(spark, d), ALL_TERMS).select("doc_id", "line_no", F.col("mask_pos").cast("bigint").alias("mask_pos"))


def _term_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of every dictionary term among all words; at most as many rows as terms."""
    counts = vocab.token_counts(corpus.document_lines(spark, d))
    listed = F.when(ALL_TERMS.contains(F.col("token")), F.struct("token", "n"))
    totals = counts.agg(F.sum("n").alias("total"), F.collect_list(listed).alias("listed"))
    return totals.select("total", F.inline("listed")).select("token", (F.col("n") / F.col("total")).alias("share"))


def _pair_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = _term_shares(spark, d)
    both = ALL_TERMS.frame(spark)
    for word, name in (("term", "p1"), ("opposite", "p2")):
        both = both.join(shares.select(F.col("token").alias(word), F.col("share").alias(name)), word, "left")
    pairs = both.select(
        F.col("term").alias("target"), F.coalesce("p1", F.lit(0.0)).alias("p1"), F.coalesce("p2", F.lit(0.0)).alias("p2")
    )
    joined = _hits(spark, d).select("doc_id", "line_no", "target").join(F.broadcast(pairs), "target")
    return joined.withColumn("p", measures.pair_probability(F.col("p1"), F.col("p2"))).where(F.col("p").isNotNull())


@query
def pair_probability(spark: SparkSession, d: str) -> DataFrame:
    return _pair_shares(spark, d).select("doc_id", "line_no", "target", _r("p"))


@query
def entropy_bias(spark: SparkSession, d: str) -> DataFrame:
    scored = _pair_shares(spark, d).withColumn("bias", measures.entropy_bias(F.col("p")))
    return scored.select("doc_id", "line_no", "target", _r("bias"))


def _grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return envs.grid_sizes(corpus.document_lines(spark, d), fixed.SEEDS, fixed.P_ENV_A)


@query
def run_tag(spark: SparkSession, d: str) -> DataFrame:
    cells = envs.experiment_grid(_grid_cells(spark, d))
    tag = tags.run_tag(F.col("seed"), F.col("p_text"), F.col("alpha_text"))
    return cells.select(
        tags.run_tag(F.col("seed"), F.col("p_text")).alias("split_tag"),
        tags.score_file(tag, F.col("method")).alias("score_file"),
        "n_a",
        "n_b",
    )


@query
def parse_run_tag(spark: SparkSession, d: str) -> DataFrame:
    """File names built from line items: line number as seed, discount as p, tax as rate."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    method = F.when(F.col("l_returnflag") == "A", "eLM").when(F.col("l_returnflag") == "R", "iLM").otherwise("none")
    rate = (
        F.when(F.col("l_tax") == 0.0, "1e-05").when(F.col("l_tax") == 0.01, "1.5e-05").otherwise(F.col("l_tax").cast("string"))
    )
    p = F.col("l_discount").cast("string")
    tag = F.when(F.col("l_linestatus") == "O", tags.run_tag(F.col("l_linenumber"), p)).otherwise(
        tags.run_tag(F.col("l_linenumber"), p, rate)
    )
    names = items.select(tags.score_file(tag, method).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = names.select(
        "name",
        "n",
        tags.parse_run_tag(F.col("name")).alias("exact"),
        tags.parse_run_tag(F.col("name"), "compat").alias("compat"),
    ).where(F.col("exact").isNotNull())
    return parsed.select(
        "name", "n", "exact.seed", "exact.p_env_a", "exact.lr", "exact.method",
        F.col("compat.p_env_a").alias("compat_p"), F.col("compat.lr").alias("compat_lr"),
    )


@query
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d)
    return log.select(
        "step",
        F.round(measures.perplexity(F.col("loss")), 6).alias("perplexity"),
        (measures.perplexity(F.col("loss") * 20) == float("inf")).alias("guarded"),
    )


@query
def round4(spark: SparkSession, d: str) -> DataFrame:
    shown = F.col("loss")
    return _events(spark, d).select("step", measures.round4(shown).alias("rounded"), measures.format4(shown).alias("shown"))


@query
def seq_len_cap(spark: SparkSession, d: str) -> DataFrame:
    requested = F.when(F.col("lang") == "en", F.col("n_chars"))
    limit = F.when(F.col("lang") == "fr", F.lit(512)).otherwise(F.lit(1_000_000)).cast("bigint")
    docs = _documents(spark, d).select("doc_id", "lang", "n_chars")
    return docs.select("doc_id", measures.block_length(requested, limit).alias("block_length"))


@query
def run_config_check(spark: SparkSession, d: str) -> DataFrame:
    sizes = envs.env_sizes(_env_lines(spark, d))
    return schedule.run_config_check([fixed.ENV_A, fixed.ENV_B], sizes, nb_steps=fixed.STEPS_PER_RUN)


# --- joins ----------------------------------------------------------------------------------------


@query
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return envs.experiment_grid(_grid_cells(spark, d)).select("seed", "p_env_a", "alpha", "method", "n_a", "n_b")


@query
def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    counts = vocab.token_counts(corpus.document_lines(spark, d))
    return terms.dict_lookup(counts, "token", ALL_TERMS, "left").select("token", "opposite", "n")


def _env_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Test items, one estimator per environment, and the size of the vocabulary."""
    counts = stage(cloze.fit_per_env(_env_lines(spark, d), asked=_test_contexts(spark, d)), "env_counts")
    items = cloze.distinct_items(cloze.cell_items(corpus.conversation_lines(spark, d), FREQUENT))
    return items, counts, cloze.vocabulary_size(counts, FREQUENT)


def _env_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidate scores of the test items under one estimator per environment."""
    items, counts, size = _env_model(spark, d)
    return cloze.candidate_scores(items, counts, [fixed.ENV_A, fixed.ENV_B], float(ALPHA), size)


@query
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    found = _env_scores(spark, d)
    return found.select("env", "ctx", "target", "opposite", "word", "n", "n_ctx", _r("logit"))


def _grid_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cells (run, epoch, env): every run and epoch of the log with every environment."""
    log = _events(spark, d)
    names = envs.env_names(log)
    return log.select("run", "epoch").distinct().withColumn("env", F.explode(F.array(*[F.lit(n) for n in names])))


@query
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return summary.missing_cells(_grid_keys(spark, d), _events(spark, d), ["run", "epoch", "env"])


@query
def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the full grid without a score file in the folder that the small grid was exported to."""
    completed = scores.completed_runs(spark, _exported_scores(spark, d))
    runs = envs.experiment_grid(_grid_cells(spark, d)).withColumnRenamed("alpha", "lr")
    keys = ["seed", "p_env_a", "lr", "method"]
    return summary.pending_runs(runs.select(*keys, "n_a"), completed, keys)


# --- aggregations and estimators ------------------------------------------------------------------


def _named_rate(line_scores: DataFrame) -> DataFrame:
    return line_scores.withColumnRenamed("alpha", "lr")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.bias_summary(_named_rate(_line_scores(spark, d, SMALL)))


@query
def bias_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("p_env_a", "lr", "method", "n_scored", _r("mean_bias"), _r("std_bias"))


@query
def ordered_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.ordered_summary(bias_summary(spark, d))


@query
def plot_series(spark: SparkSession, d: str) -> DataFrame:
    series = summary.plot_series(_summary(spark, d))
    point = lambda x: F.concat_ws(
        ":", x["p_env_a"].cast("string"), F.format_string("%.4f", x["mean_bias"]), F.format_string("%.4f", x["std_bias"])
    )
    return series.select("lr", "method", F.array_join(F.transform("series", point), " ").alias("series"))


@query
def scored_count(spark: SparkSession, d: str) -> DataFrame:
    return summary.scored_count(_line_scores(spark, d, SMALL), ["seed", "p_env_a", "alpha", "method"])


@query
def env_sizes(spark: SparkSession, d: str) -> DataFrame:
    return envs.env_sizes(_env_lines(spark, d))


@query
def size_summary(spark: SparkSession, d: str) -> DataFrame:
    return envs.size_summary(envs.env_sizes(_env_lines(spark, d)))


@query
def round_plan(spark: SparkSession, d: str) -> DataFrame:
    columns = ("rounds", "steps_per_epoch", "epochs", "max_steps")
    sizes = envs.env_sizes(_env_lines(spark, d))
    per_env = schedule.round_plan(sizes).select(F.lit("iLM").alias("method"), *columns)
    pooled = schedule.pooled_plan(sizes).select(
        F.lit("eLM").alias("method"), F.col("n_batches").alias("rounds"), *columns[1:]
    )
    return per_env.unionByName(pooled)


@query
def examples_seen(spark: SparkSession, d: str) -> DataFrame:
    """Examples of three epochs; the number of steps follows from the sizes of the environments."""
    plan = schedule.round_plan(envs.env_sizes(_env_lines(spark, d)), nb_steps=None, num_epochs=3)
    return schedule.examples_seen(plan).select("max_steps", "examples_seen")


@query
def epoch_env_loss(spark: SparkSession, d: str) -> DataFrame:
    """Short epochs of ten events, in which some environments have no update."""
    log = _events(spark, d)
    short = log.withColumn("epoch", F.floor(F.col("step") / 10).cast("bigint"))
    return runlog.epoch_env_loss(short, envs.env_names(log)).select("epoch", "env", _r("avg_loss"), "n_updates")


@query
def round_loss(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of five events; only those of type ``view`` are updates, so some rounds have none."""
    log = _events(spark, d)
    return runlog.round_loss(log.where(F.col("env") == "view"), log).select("epoch", "round", _r("avg_loss"))


@query
def batch_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    losses = _events(spark, d).select(F.col("run").alias("batch"), "loss")
    return runlog.batch_mean_loss(losses).select(_r("eval_loss"), _r("token_loss"), "n_batches")


def _eval_losses(spark: SparkSession, d: str) -> DataFrame:
    positions = evaluation.masked_positions(corpus.benchmark_lines(spark, d), SEED)
    return evaluation.position_losses(_model(spark, d, ONE_CELL, _val_contexts(spark, d)), positions)


@query
def masked_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.masked_cross_entropy(_eval_losses(spark, d)).select("method", "n_positions", _r("loss"))


@query
def model_eval(spark: SparkSession, d: str) -> DataFrame:
    result = evaluation.model_eval(_model(spark, d, ONE_CELL, _val_contexts(spark, d)), corpus.benchmark_lines(spark, d), SEED)
    return result.select("method", _r("eval_loss"), _r("token_loss"), "n_batches", _r("perplexity", 3))


@query
def loss_by_step_interval(spark: SparkSession, d: str) -> DataFrame:
    found = runlog.loss_by_step_interval(_events(spark, d))
    return found.select("run", "epoch", "step", _r("running_loss"))


@query
def running_epoch_loss(spark: SparkSession, d: str) -> DataFrame:
    return runlog.running_epoch_loss(_events(spark, d)).select("run", "epoch", "step", _r("running_loss"))


@query
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d)
    best = runlog.best_checkpoint(log).select("run", "step", F.lit(True).alias("is_best"))
    better = runlog.improvements(log).select("run", "step", "loss")
    return better.join(best, ["run", "step"], "left").select(
        "run", "step", _r("loss"), F.coalesce("is_best", F.lit(False)).alias("is_best")
    )


@query
def build_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocab.build_vocab(corpus.document_lines(spark, d))


def _encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Encoded environment lines, and their whole vocabulary as a written table."""
    # Swapped once, for the vocabulary and for the ids.
    env_lines = stage(_env_lines(spark, d), "env_lines")
    words = stage(vocab.build_vocab(env_lines), "vocab")
    return vocab.encode_tokens(env_lines, words, ("env", "doc_id", "line_no")), words


@query
def encode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d)[0].select("env", "doc_id", "line_no", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def fit_pooled(spark: SparkSession, d: str) -> DataFrame:
    return cloze.fit_pooled(_env_lines(spark, d))


@query
def fit_per_env(spark: SparkSession, d: str) -> DataFrame:
    return cloze.fit_per_env(_env_lines(spark, d))


@query
def env_head_score(spark: SparkSession, d: str) -> DataFrame:
    found = _env_scores(spark, d)
    one = cloze.env_head_score(found, fixed.ENV_A)
    return cloze.pair_bias(one).select("ctx", "target", "opposite", _r("p1"), _r("p2"), _r("bias"))


@query
def mean_head_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the environments, normalised over the vocabulary."""
    items, counts, size = _env_model(spark, d)
    mean = cloze.normalised_mean(items, counts, 2, float(ALPHA), size)
    return mean.select("ctx", "target", "opposite", "word", _r("logit"))


@query
def line_bias(spark: SparkSession, d: str) -> DataFrame:
    return _line_scores(spark, d, ONE_CELL).select("doc_id", "line_no", "method", "target", "opposite", _r("bias"))


def _lang_model(spark: SparkSession, d: str, asked: DataFrame) -> environments.EnvModel:
    """Estimators of the languages, read back from a folder of environment files."""
    folder = new_folder(spark, "languages")
    writers.write_env_folder(_lang_lines(spark, d), folder)
    return environments.fit_environments(corpus.env_folder_scan(spark, folder), FREQUENT, float(ALPHA), asked=asked)


@query
def env_line_bias(spark: SparkSession, d: str) -> DataFrame:
    """Bias under the pooled estimator, the mean of all languages, and the one of a single language."""
    model = _lang_model(spark, d, _test_contexts(spark, d))
    found = model.line_bias(corpus.conversation_lines(spark, d), [*fixed.METHODS, "en"])
    return found.select("doc_id", "line_no", "method", "target", "opposite", _r("bias"))


@query
def env_model_eval(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation of the estimators of all languages on the turns of conversations, whose keys are text."""
    lines = corpus.conversation_lines(spark, d)
    # The chosen positions do not depend on the batches.
    asked = evaluation.masked_positions(lines, SEED).select("ctx")
    result = _lang_model(spark, d, asked).evaluate(lines, SEED, fixed.METHODS)
    return result.select("method", _r("eval_loss"), _r("token_loss"), "n_batches", _r("perplexity", 3))


# --- ordered work ---------------------------------------------------------------------------------


def _numbered_encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Encoded lines with their number in the environment, and the vocabulary.

    The numbers are those of the bare keys; the ids are moved once to meet them, and once into their batches.
    """
    encoded, words = _encoded(spark, d)
    keys = corpus.document_lines(spark, d).select(envs.line_env(SEED, float(P)).alias("env"), "doc_id", "line_no")
    numbers = ranged_index(keys, ["env"], ["doc_id", "line_no"])
    return encoded.join(numbers, ["env", "doc_id", "line_no"]), words


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    numbered, words = _numbered_encoded(spark, d)
    return packing.pack_blocks(numbered, BLOCK), words


def _joined_ids(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


@query
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d)[0].select("env", "batch_id", "block_id", _joined_ids("input_ids"))


@query
def packing_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_numbered_encoded(spark, d)[0], BLOCK)


@query
def mlm_mask(spark: SparkSession, d: str) -> DataFrame:
    blocks, words = _blocks(spark, d)
    masked = masking.mlm_mask(blocks, SEED, words.count(), ("env", "batch_id", "block_id"))
    return masked.select("env", "batch_id", "block_id", _joined_ids("input_ids"), _joined_ids("labels"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Environment lines as examples; only their keys are needed."""
    keys = corpus.document_lines(spark, d).select("doc_id", "line_no")
    return stage(keys.select(envs.line_env(SEED, float(P)).alias("env"), "doc_id", "line_no"), "examples")


def _pooled_examples(examples: DataFrame) -> DataFrame:
    return envs.pooled_train(examples).drop("part")


@query
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    examples = _examples(spark, d)
    found = schedule.shuffled_batches(examples, SEED, examples.count())
    return found.select("epoch", "env", "doc_id", "line_no", "idx", "batch_no")


@query
def rank_shards(spark: SparkSession, d: str) -> DataFrame:
    examples = _examples(spark, d)
    numbered = schedule.shuffled_batches(examples, SEED, examples.count())
    return schedule.rank_shards(numbered, RANKS).select("env", "doc_id", "line_no", "idx", "rank")


def _round_robin(spark: SparkSession, d: str) -> DataFrame:
    examples = _examples(spark, d)
    return schedule.round_robin_schedule(examples, envs.env_sizes(examples), SEED)


def _pooled_steps(spark: SparkSession, d: str) -> DataFrame:
    pooled = _pooled_examples(_examples(spark, d))
    return schedule.pooled_schedule(pooled, envs.env_sizes(pooled), SEED)


@query
def round_robin_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _round_robin(spark, d).select("epoch", "round", "env", "batch_no", "step", "doc_id", "line_no")


def _lang_schedule(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """Schedule of all languages and an empty environment, the number of languages, and the step limit: one
    epoch and half a round, so that the limit cuts a round short."""
    examples = stage(_lang_lines(spark, d).select("env", "doc_id", "line_no"), "examples")
    langs = envs.env_names(examples)
    sizes = envs.env_sizes(examples, [*langs, "none"])
    plan = schedule.round_plan(sizes.where("n > 0"), accumulation=1, nb_steps=None, num_epochs=1).first()
    limit = plan.max_steps + len(langs) // 2
    return schedule.round_robin_schedule(examples, sizes, SEED, nb_steps=limit, accumulation=1), len(langs), limit


@query
def round_robin_three(spark: SparkSession, d: str) -> DataFrame:
    """More than two environments and an empty one, up to a step limit that cuts a round short."""
    steps, _, _ = _lang_schedule(spark, d)
    return steps.select("epoch", "round", "env", "batch_no", "step", "doc_id", "line_no")


@query
def log_steps_three(spark: SparkSession, d: str) -> DataFrame:
    """Logged every two steps: at the ends of rounds, and where the limit ends the run inside a round."""
    steps, n_env, limit = _lang_schedule(spark, d)
    return schedule.log_steps(steps, interval=2, n_env=n_env, max_steps=limit).select("epoch", "step")


@query
def pooled_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _pooled_steps(spark, d).select("epoch", "batch_no", "step", "doc_id", "line_no")


@query
def log_steps(spark: SparkSession, d: str) -> DataFrame:
    per_env = schedule.log_steps(_round_robin(spark, d), n_env=2, max_steps=fixed.STEPS_PER_RUN)
    pooled = schedule.log_steps(_pooled_steps(spark, d))
    return per_env.select(F.lit("iLM").alias("method"), "epoch", "step").unionByName(
        pooled.select(F.lit("eLM").alias("method"), "epoch", "step")
    )


@query
def checkpoint_steps(spark: SparkSession, d: str) -> DataFrame:
    return schedule.checkpoint_steps(_round_robin(spark, d), CHECKPOINT_EVERY)


@query
def step_limit(spark: SparkSession, d: str) -> DataFrame:
    return schedule.step_limit(_events(spark, d), fixed.STEPS_PER_RUN).select("run", "step", "env", _r("loss"))


# --- sets -----------------------------------------------------------------------------------------


@query
def pooled_train(spark: SparkSession, d: str) -> DataFrame:
    return envs.pooled_train(_env_lines(spark, d)).select("env", "part", "doc_id", "line_no", "line")


@query
def env_list(spark: SparkSession, d: str) -> DataFrame:
    env_lines = _env_lines(spark, d).select("env").distinct()
    both = env_lines.unionByName(env_lines.select(F.lit(fixed.POOLED_ENV).alias("env")))
    per_env = envs.env_list(both).select(F.lit("iLM").alias("method"), "env")
    pooled = envs.env_list(both, pooled=True).select(F.lit("eLM").alias("method"), "env")
    return per_env.unionByName(pooled)


# --- user functions -------------------------------------------------------------------------------


@query
def map_batches(spark: SparkSession, d: str) -> DataFrame:
    def count_words(columns: dict[str, pa.Array]) -> dict[str, pa.Array]:
        found = pc.count_substring_regex(columns["line"], r"[\p{L}\p{N}_]+")
        return {"doc_id": columns["doc_id"], "line_no": columns["line_no"], "n_words": found}

    lines = corpus.document_lines(spark, d).select("doc_id", "line_no", "line")
    return _map_batches(lines, count_words, "doc_id bigint, line_no int, n_words bigint")


@query
def masked_scorer(spark: SparkSession, d: str) -> DataFrame:
    tokens = vocab.line_tokens(corpus.document_lines(spark, d)).where(FREQUENT.contains(F.col("token")))
    # At most two rows per term of the dictionary.
    counts = tokens.groupBy("token", (F.col("pos") == 0).alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()
    by_place = {(row.token, row["first"]): row.n for row in counts}
    hits = terms.mask_hits(terms.single_hits(corpus.conversation_lines(spark, d), FREQUENT), FREQUENT)
    scored = _masked_scorer(hits, place_scorer(by_place, FREQUENT.terms, float(ALPHA)))
    biased = scored.withColumn("p", measures.pair_probability(F.col("p1"), F.col("p2"))).where(F.col("p").isNotNull())
    return biased.select(
        "doc_id", "line_no", "target", _r("p1"), _r("p2"), F.round(measures.entropy_bias(F.col("p")), 6).alias("bias")
    )


@query
def model_scorer(spark: SparkSession, d: str) -> DataFrame:
    """A scorer outside the plan that sees the fitted estimators; the bias of every line equals ``line_bias``."""
    counts = stage(cloze.fit_per_env(_env_lines(spark, d), asked=_test_contexts(spark, d)), "env_counts")
    size = cloze.vocabulary_size(counts, FREQUENT)
    hits = terms.mask_hits(terms.single_hits(corpus.conversation_lines(spark, d), FREQUENT), FREQUENT)
    hits = stage(cloze.hit_items(hits).select("doc_id", "line_no", "masked", "ctx", "target", "opposite"), "hits")
    evidence = cloze.item_evidence(hits, counts, 2, float(ALPHA))
    asked = ["n_target", "n_opposite", "seen_sum", "n_seen"]
    scored = _masked_scorer(
        hits.join(evidence, ["ctx", "target", "opposite"], "left"),
        count_scorer(2, float(ALPHA), size),
        evidence=asked,
    )
    biased = scored.withColumn("p", measures.pair_probability(F.col("p1"), F.col("p2"))).where(F.col("p").isNotNull())
    return biased.select("doc_id", "line_no", "target", "opposite", F.round(measures.entropy_bias(F.col("p")), 6).alias("bias"))
