"""The registered queries of the operators, each over its whole table with production parameters.

The queries of ``oracles`` have SQL. The others have none: fingerprints by XXH64, suffix arrays, trained models,
sampled seatings and tokenizers are beyond it. The tests hold each query against a brute-force version, an exact
round trip or held-out accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact.llm import language_id, pitman_yor, quality_ranking
from counterfact.llm.bpe_automaton import encode_and_decode
from counterfact.llm.conversation_trie import conversation_turns, prefix_trie, regrafted
from counterfact.llm.decontamination import contaminated
from counterfact.llm.embedding_dedup import near_copies
from counterfact.llm.hard_negatives import hard_negatives
from counterfact.llm.oracles import ORACLES  # noqa: F401
from counterfact.llm.pii import fit as fit_pii
from counterfact.llm.pii import tag_pii
from counterfact.llm.quality_rules import quality_rules
from counterfact.llm.secret_scan import secret_scan
from counterfact.llm.simhash import near_duplicates
from counterfact.llm.staging import stage_compact
from counterfact.llm.token_packing import pack_texts

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """Vocabulary file of the registered queries, on the driver."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query
def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document; three-word shingles, at most two bits apart."""
    return near_duplicates(documents(spark, d), shingle=3, distance=2)


@query
def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules(documents(spark, d), carry=["doc_id"])


@query
def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document, packed into rows of 2,048."""
    return pack_texts(documents(spark, d), tokenizer_path())


@query
def op4_quality_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document; learned from all labelled documents that are not held out."""
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    held = quality_ranking.held_out()
    # Measured once, for the fit and for the scores.
    vectors = stage_compact(quality_ranking.measured(docs, carry=["doc_id"]), "vectors")
    ranked = quality_ranking.rank_measured(vectors, quality_ranking.fit_measured(vectors, labels, ~held))
    return ranked.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op5_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data of every document; the tagger is fitted on a sample of 2,000 documents at most."""
    docs = documents(spark, d)
    return tag_pii(docs, fit_pii(docs), carry=["doc_id"])


@query
def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document; learned from 1,000 documents of each language at most."""
    docs = documents(spark, d)
    held = language_id.held_out()
    found = language_id.identify(docs, language_id.fit(docs, ~held), carry=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_pitman_yor(spark: SparkSession, d: str) -> DataFrame:
    """Log-probability of every document under the sampled model, and under counts with one added."""
    return pitman_yor.score_texts(documents(spark, d), pitman_yor.held_out())


@query
def op8_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    coded = encode_and_decode(documents(spark, d), tokenizer_path(), carry=["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, with the item and the score."""
    return contaminated(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query
def op10_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of every document; the source owns a document."""
    return secret_scan(documents(spark, d), owner="source")


@query
def op11_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, their first turns taken from the first of their family."""
    turns = conversation_turns(spark.read.parquet(f"{d}/conversations.parquet"))
    return prefix_trie(regrafted(turns, family=20, heads=4))


@query
def op12_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Links and components of all vectors; the index is fitted on 16,384 of them at most."""
    return near_copies(spark.read.parquet(f"{d}/embeddings.parquet"), threshold=0.93)


@query
def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all; the label of every seventh is another one first."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0, positives=5, negatives=3)
