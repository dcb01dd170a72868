"""Line corpora: from tables with a text column and from folders of text files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text

# Environment name in a path: the part of `<name>.txt` before its first dot. The file may be a
# plain file, a folder that Spark wrote, or one of the folders `env=<name>.txt` of a table.
_ENV_IN_PATH = r"/(?:env=)?([^/.]*)[^/]*\.txt(?:/part-[^/]+)?$"
_TABLE_FOLDER = r"/env=[^/]*\.txt/part-[^/]+$"


def table_lines(df: DataFrame, *keys: str, text_column: str = "text") -> DataFrame:
    """One row per line of a text column: keys, ``line_no`` from 0, ``line``."""
    return df.select(*keys, F.posexplode(F.split(F.col(text_column), "\n")).alias("line_no", "line"))


def clean_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Strip every line and drop the empty ones."""
    return lines.withColumn(column, text.strip_line(F.col(column))).where(F.col(column) != "")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training corpus: clean lines of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(table_lines(docs, "doc_id"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test corpus: clean lines of ``conversations``, keyed by conversation and turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    keyed = turns.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return clean_lines(table_lines(keyed, "doc_id"))


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation corpus: clean lines of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS doc_id", "text")
    return clean_lines(table_lines(items, "doc_id"))


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three splits as one table ``(split, doc_id, line_no, line)``."""
    parts = {
        "train": document_lines(spark, sf_dir),
        "val_ind": benchmark_lines(spark, sf_dir),
        "test": conversation_lines(spark, sf_dir),
    }
    frames = [
        lines.select(F.lit(name).alias("split"), F.col("doc_id").cast("string").alias("doc_id"), "line_no", "line")
        for name, lines in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def eval_split_select(corpus: DataFrame, eval_type: str = "ind") -> DataFrame:
    """Lines of the evaluation split of a type; an error when it holds none."""
    selected = corpus.where(F.col("split") == fixed.VAL_PREFIX + eval_type)
    if selected.isEmpty():
        raise ValueError(f"no evaluation split {fixed.VAL_PREFIX}{eval_type}")
    return selected


def env_folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a folder of ``<env>.txt`` files; the pooled file and other suffixes are left out."""
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt")
    return lines.select(_env_of_path().alias("env"), F.col("value").alias("line")).where(
        F.col("env") != fixed.POOLED_ENV
    )


def stored_streams(spark: SparkSession, folder: str) -> DataFrame:
    """The nested streams of a folder that ``write_streams`` wrote."""
    return spark.read.parquet(folder).withColumn("from_p", F.col("from_p").cast("string"))


def single_file_env(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file as the pooled environment."""
    return spark.read.text(path).select(F.lit(fixed.POOLED_ENV).alias("env"), F.col("value").alias("line"))


def nonempty_eval_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the non-empty ``<split>.txt`` files of a validation folder."""
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt").where(F.col("_metadata.file_size") > 0)
    return lines.select(_env_of_path().alias("split"), F.col("value").alias("line"))


def skipped_eval_files(spark: SparkSession, folder: str, wanted: Sequence[str] = ()) -> DataFrame:
    """Report ``(split, reason)`` of validation files that are empty, or wanted and missing.

    A scan skips files without bytes, so the names come from the file listing of the source.
    """
    glob = f"{folder.rstrip('/')}/*.txt"
    found = (re.search(_ENV_IN_PATH, f) for f in spark.read.text(glob).inputFiles())
    listed = {unquote(m.group(1)) for m in found if m}
    names = spark.createDataFrame(
        [(n, "empty" if n in listed else "missing") for n in sorted(listed | set(wanted))],
        "split string, reason string",
    )
    filled = (
        spark.read.format("binaryFile")
        .load(glob)
        .select(F.regexp_extract("path", _ENV_IN_PATH, 1).alias("split"))
        .distinct()
    )
    return names.join(filled, "split", "left_anti")


def test_lines_scan(lines: DataFrame) -> DataFrame:
    """Stripped, non-blank test lines."""
    return clean_lines(lines)


def text_column_pick(df: DataFrame) -> DataFrame:
    """The text column of a table: ``content`` if present, otherwise the first."""
    name = "content" if "content" in df.columns else df.columns[0]
    return df.select(F.col(name).alias("text"))


def _env_of_path():
    """Name in the path of the file read. The path is percent-encoded, the name of a table's folder once more;
    a plus sign stands for itself."""
    path = F.col("_metadata.file_path")
    plain = lambda name: F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    name = plain(F.regexp_extract(path, _ENV_IN_PATH, 1))
    return F.when(path.rlike(_TABLE_FOLDER), plain(name)).otherwise(name)
