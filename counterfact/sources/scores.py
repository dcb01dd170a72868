"""Score files of many runs as one table, the parameters decoded from the file names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact.functions.tags import parse_run_tag

# Rows of the marks that an export leaves: the file name of a run, the attempt, what it did, and when.
MARKS = "run_file string, attempt string, state string, at bigint"


def marks_folder(folder: str) -> str:
    """Where the marks of a folder of scores are; readers of the folder pass it over."""
    return f"{folder.rstrip('/')}/_runs"


# Name of a score file in a path: a plain file, or a folder that Spark wrote under that name.
_NAME_IN_PATH = r"([^/=]+\.csv)(?:/part-[^/]*)?$"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, _NAME_IN_PATH, 1)


def scores_scan(spark: SparkSession, folder: str, mode: str = "exact") -> DataFrame:
    """Rows ``(seed, p_env_a, lr, method, bias)`` of all score files; other names are left out."""
    rows = (
        spark.read.schema("bias double")
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(folder)
        .select(parse_run_tag(_name(F.col("_metadata.file_path")), mode).alias("run"), "bias")
    )
    return rows.where(F.col("run").isNotNull()).select("run.*", "bias")


def _file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names of the files in the folder, without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(_name(F.col("path")).alias("name")).distinct()


def ignored_score_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the folder that are not those of score files."""
    return _file_names(spark, folder).where(parse_run_tag(F.col("name")).isNull())


def unfinished_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names ``(name)`` of the runs whose last attempt to write them was begun and not completed."""
    try:
        marks = spark.read.schema(MARKS).parquet(marks_folder(folder))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        marks = spark.createDataFrame([], MARKS)
    begun = F.when(F.col("state") == "begun", F.struct("at", "attempt"))
    done = F.collect_set(F.when(F.col("state") == "completed", F.col("attempt")))
    last = marks.groupBy("run_file").agg(F.max(begun).alias("last"), done.alias("done"))
    return last.where(~F.array_contains("done", F.col("last.attempt"))).select(F.col("run_file").alias("name"))


def completed_runs(spark: SparkSession, folder: str, mode: str = "exact") -> DataFrame:
    """Runs ``(seed, p_env_a, lr, method)`` whose score file is in the folder and complete.

    A run that an export has begun to write is complete when the marks say that it was committed. A score file
    without marks was not written by an export, and is complete by being there.
    """
    run = F.array(parse_run_tag(F.col("name"), mode))
    names = _file_names(spark, folder).join(unfinished_files(spark, folder), "name", "left_anti")
    # A name is taken apart once: no filter or field is moved below the inline.
    return names.select(F.inline(F.filter(run, lambda r: r.isNotNull()))).distinct()


def union_scores(spark: SparkSession, folder: str, mode: str = "exact") -> DataFrame:
    """All scores of all runs; an error when the folder holds no score file."""
    if completed_runs(spark, folder, mode).isEmpty():
        raise ValueError("no valid score file found")
    return scores_scan(spark, folder, mode)
