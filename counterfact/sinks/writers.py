"""Sinks for splits, scores, logs and results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from counterfact import fixed
from counterfact.functions.measures import format4
from counterfact.functions.tags import run_tag, score_file
from counterfact.operators.dictionary import TermDictionary
from counterfact.operators.environments import grid_assign, grid_cells
from counterfact.operators.index import bucket_count
from counterfact.operators.runlog import loss_history
from counterfact.sources.scores import MARKS, marks_folder

# Folders of a training log; a run is in one of them.
LOG_FOLDERS = 32
# Files a task keeps open.
OPEN_FILES = 32


def write_splits(cell_lines: DataFrame, folder: str) -> None:
    """Lines of all grid cells in one job, partitioned by seed, p and environment.

    The rebalance gives files of even size: a large environment is split over several tasks.
    """
    rows = cell_lines.select("seed", F.col("p_text").alias("p_env_a"), "env", "doc_id", "line_no", "line")
    (
        rows.hint("rebalance", "seed", "p_env_a", "env")
        .write.mode("overwrite")
        .partitionBy("seed", "p_env_a", "env")
        .parquet(folder)
    )


def write_streams(streams: DataFrame, folder: str) -> None:
    """The nested streams of all cells in one job: a line is written once or twice a seed, not once for each p.

    Lines are written where they lie, to a folder for each ``from_p`` and side. The seeds share these folders, and the
    rows of a line follow each other there, so that a line which several seeds draw into one folder takes little more
    room than one. A task keeps the files of its folders open; it neither shuffles nor sorts its lines.
    """
    rows = streams.select("seed", "from_p", "side", "doc_id", "line_no", "line")
    with _open_files(rows.sparkSession, OPEN_FILES):
        (
            rows.write.mode("overwrite")
            .option("compression", "zstd")
            .option("parquet.compression.codec.zstd.level", 6)
            # Long pages hold repetitions together; small row groups bound the memory of the open files.
            .option("parquet.page.size", 4 << 20)
            .option("parquet.block.size", 16 << 20)
            .partitionBy("from_p", "side")
            .parquet(folder)
        )


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks that write several folders keep up to ``most`` files open; rows of further folders are sorted first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_env_folder(env_lines: DataFrame, folder: str) -> None:
    """Lines of all environments in one job, a folder ``env=<name>.txt`` for each, as the folder scan reads them."""
    rows = env_lines.select(F.concat("env", F.lit(".txt")).alias("env"), "line")
    rows.hint("rebalance", "env").write.mode("overwrite").partitionBy("env").text(folder)


def split_files(cell_lines: DataFrame, validation: DataFrame, test: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows ``(seed, p_env_a, file, part, doc_no, doc_id, line_no, line)`` of all text files of all cells.

    Documents are in order of ``doc_no``, their number if they have one, then of ``doc_id`` as text.

    A line of training text is in the file of its environment and in the pooled file, where ``part`` puts
    environment A before B. Validation and test text are the same for every cell ``(seed, p_text)``.
    """
    return _train_files(cell_lines).unionByName(_held_out_files(validation, test, cells))


def _place(lines: DataFrame) -> list[Column]:
    """Place of a line in the order of the files."""
    number = F.col("doc_id") if isinstance(lines.schema["doc_id"].dataType, IntegralType) else F.lit(None)
    return [number.cast("bigint").alias("doc_no"), F.col("doc_id").cast("string").alias("doc_id"), F.col("line_no")]


def _train_files(cell_lines: DataFrame) -> DataFrame:
    files = F.explode(F.array(F.col("env"), F.lit(fixed.POOLED_ENV))).alias("file")
    return cell_lines.select(
        "seed", F.col("p_text").alias("p_env_a"), files, F.col("env").alias("part"), *_place(cell_lines), "line"
    )


def _held_out_files(validation: DataFrame, test: DataFrame, cells: DataFrame) -> DataFrame:
    return _in_cells(_held_out_lines(validation, test), cells)


def _held_out_lines(validation: DataFrame, test: DataFrame) -> DataFrame:
    return validation.select(F.lit(f"{fixed.VAL_PREFIX}ind").alias("file"), *_place(validation), "line").unionByName(
        test.select(F.lit("test").alias("file"), *_place(test), "line")
    )


def _in_cells(held: DataFrame, cells: DataFrame) -> DataFrame:
    # The cells are a setting of the experiment; every one gets the same held-out text.
    cell_list = [F.struct(F.lit(r["seed"]).alias("seed"), F.lit(r["p_text"]).alias("p_env_a")) for r in cells.collect()]
    return held.select(F.explode(F.array(*cell_list)).alias("_c"), "*").select(
        "_c.seed", "_c.p_env_a", "file", F.lit("").alias("part"), "doc_no", "doc_id", "line_no", "line"
    )


def export_split_text(rows: DataFrame, folder: str) -> None:
    """Text of all files of all cells in one job, a folder for each seed, p and file.

    The rows are split into ranges over the files and the order inside them, so that the parts of a folder
    hold its lines in order, and a large file is written by several tasks. An export replaces an earlier one.
    """
    _write_text(rows.repartitionByRange("seed", "p_env_a", "file", *_TEXT_ORDER), folder)


def export_cell_text(
    lines: DataFrame,
    dictionary: TermDictionary,
    seeds: Sequence[int],
    p_values: Sequence[str],
    validation: DataFrame,
    test: DataFrame,
    folder: str,
    compression: str = "none",
) -> None:
    """The files of ``split_files`` for all cells (seed, p) of training lines, with the same lines in the same order.

    A line is moved once, to its range in the order of the documents, and is swapped and dealt to cells and files
    there: of training text in tasks for environment A, and after these in tasks for B, which read the same ranges.
    The files are plain text; ``compression`` may be ``gzip``.
    """
    copies = 2 * len(seeds) * len(p_values)
    n_ranges = bucket_count(lines.sparkSession, lines.count() * copies)
    ranged = lines.select("doc_id", "line_no", "line").repartitionByRange(n_ranges, *_place(lines))
    sides = [_train_files(grid_assign(ranged, dictionary, seeds, p_values, side)) for side in (fixed.ENV_A, fixed.ENV_B)]
    names = lines.sparkSession.range(1).select(F.inline(grid_cells(seeds, p_values)))
    held = _held_out_lines(validation, test)
    n_held = bucket_count(lines.sparkSession, held.count() * len(seeds) * len(p_values))
    held = held.repartitionByRange(n_held, "file", "doc_no", "doc_id", "line_no")
    _write_text(sides[0].unionByName(sides[1]).unionByName(_in_cells(held, names)), folder, compression)


_TEXT_ORDER = ("part", "doc_no", "doc_id", "line_no")


def _write_text(rows: DataFrame, folder: str, compression: str = "none") -> None:
    """Rows in order of their partitions, and ordered in each, as a folder of text for each seed, p and file."""
    (
        rows.sortWithinPartitions("seed", "p_env_a", "file", *_TEXT_ORDER)
        .select("seed", "p_env_a", "file", "line")
        .write.mode("overwrite")
        .option("compression", compression)
        # Of gzip: a third of the time of its usual level, for files that are 4 % larger.
        .option("zlib.compress.level", "FOUR")
        .partitionBy("seed", "p_env_a", "file")
        .text(folder)
    )


def write_scores(scores: DataFrame, folder: str) -> None:
    """Scores of all runs in one job, partitioned by the parameters of the run."""
    rows = scores.select(
        "seed", F.col("p_text").alias("p_env_a"), F.col("alpha_text").alias("alpha"), "method",
        "doc_id", "line_no", "bias",
    )
    (
        rows.hint("rebalance", "seed", "p_env_a", "alpha", "method")
        .write.mode("overwrite")
        .partitionBy("seed", "p_env_a", "alpha", "method")
        .parquet(folder)
    )


def export_scores_csv(scores: DataFrame, folder: str) -> None:
    """One column ``bias`` per run, under the tagged file name of the run; a run that is written again
    replaces its earlier scores only.

    A mark is left before the job begins and another one after it is committed, so that a run whose files were
    only half replaced is not taken for a completed one. ``scores`` is read twice, and best a written table.
    """
    tag = run_tag(F.col("seed"), F.col("p_text"), F.col("alpha_text"))
    rows = scores.select(score_file(tag, F.col("method")).alias("run_file"), "bias")
    # One row for a run.
    runs = [r.run_file for r in rows.select("run_file").distinct().collect()]
    attempt = uuid.uuid4().hex
    _mark(rows.sparkSession, folder, runs, attempt, "begun")
    (
        rows.hint("rebalance", "run_file")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("run_file")
        .csv(folder)
    )
    _mark(rows.sparkSession, folder, runs, attempt, "completed")


def _mark(spark: SparkSession, folder: str, runs: Sequence[str], attempt: str, state: str) -> None:
    """Append a row for every run to the marks of a folder of scores."""
    rows = [(run, attempt, state, time.time_ns()) for run in runs]
    marks = spark.createDataFrame(rows, MARKS).coalesce(1)
    marks.write.mode("append").parquet(marks_folder(folder))


def write_training_log(rows: DataFrame, folder: str) -> None:
    """Log rows with four decimals; the runs that are written replace their earlier rows only.

    Runs are dealt to a fixed number of folders, so that files do not become as many as runs. The folders of the
    runs that are written are written anew, with the earlier rows of their other runs; one writer at a time. If
    there is an earlier log, ``rows`` is read more than once.
    """
    numbers = ("train_loss", "val_loss", "perplexity")
    # A blank and no name are the same, as in the file.
    run = F.nullif(F.col("run").cast("string"), F.lit(""))
    shown = rows.select(
        *[F.col(c).cast("string").alias(c) for c in ("epoch", "global_step")],
        *[format4(F.col(c)).alias(c) for c in numbers],
        run.alias("run"),
        F.pmod(F.xxhash64(run), F.lit(LOG_FOLDERS)).cast("int").alias("part"),
    )
    earlier = _earlier_log(rows.sparkSession, folder)
    if earlier is not None:
        kept = earlier.join(shown.select("part").distinct(), "part", "left_semi")
        runs = shown.select(F.col("run").alias("_run")).distinct()
        kept = kept.join(runs, F.col("run").eqNullSafe(F.col("_run")), "left_anti")
        shown = shown.unionByName(kept)
    (
        shown.hint("rebalance", "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .partitionBy("part")
        .csv(folder)
    )


def _earlier_log(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of a folder of log rows as they were written, if there is one."""
    names = ("epoch", "global_step", "train_loss", "val_loss", "perplexity", "run")
    schema = ", ".join([*[f"{n} string" for n in names], "part int"])
    try:
        return spark.read.option("header", True).option("multiLine", True).schema(schema).csv(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_loss_history(log: DataFrame, envs: Sequence[str], folder: str) -> None:
    """Wide table of the mean loss per epoch and environment; blank without data.

    One file: the table has one row per epoch.
    """
    wide = loss_history(log, envs).withColumnRenamed("epoch", "Epoch")
    wide.orderBy("Epoch").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def eval_result_lines(results: DataFrame) -> DataFrame:
    """Lines ``key = value`` in order of key, from rows ``(key, value)``."""
    return results.orderBy("key").select(F.concat(F.col("key"), F.lit(" = "), F.col("value").cast("string")).alias("line"))


def write_eval_results(results: DataFrame, folder: str) -> None:
    """Write the ``key = value`` lines; one line per metric."""
    eval_result_lines(results).coalesce(1).write.mode("overwrite").text(folder)
