"""Pipeline over ``documents``: stages that pass a table of documents on, each written and read again.

Every stage but the last returns the columns of its documents. Columns of the table beside those of
``documents`` are carried, whatever their names; a null text is a text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact.llm.batches import free_name, quoted
from counterfact.llm.bpe_automaton import encode_and_decode
from counterfact.llm.decontamination import with_matches
from counterfact.llm.pii import fit, tag_pii
from counterfact.llm.quality_rules import quality_rules
from counterfact.llm.queries import tokenizer_path
from counterfact.llm.simhash import one_of_each
from counterfact.llm.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prefix = "_rules_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = quality_rules(docs, prefix=prefix).where(F.col(f"{prefix}kept"))
    return judged.select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, shingle=3, distance=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    copies = free_name(docs, "_copies")
    marked = with_matches(docs, benchmark, column=copies)
    return marked.where(F.size(copies) == 0).select(*map(quoted, docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the names of the kinds in place of personal data, and the new number of characters."""
    column = free_name(docs, "_redacted")
    marked = tag_pii(docs, fit(docs), redact=True, column=column)
    new = {"text": F.col(column)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.char_length(column).cast(kind)
        new["n_chars"] = F.when(F.col(column).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(size)
    return marked.select(*[new.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number; under names of their own if these are taken."""
    carried = {f"_carried{i}": c for i, c in enumerate(c for c in docs.columns if c != "text")}
    plain = docs.select("text", *[F.col(quoted(c)).alias(k) for k, c in carried.items()])
    coded = encode_and_decode(plain, tokenizer_path(), carry=list(carried), part_bytes=4 << 20)
    made = [F.col(c).alias(free_name(docs, c)) for c in coded.columns if c not in carried and c != "decoded"]
    return coded.select(*[F.col(k).alias(c) for k, c in carried.items()], *made)


#: Name and function of each stage, in order.
STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("tokenize", tokenize),
]

#: No SQL: the stages use suffix arrays, XXH64, alignments, a trained tagger and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
