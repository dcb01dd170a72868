"""Estimators of any environments: one per environment, their mean, and the pooled one.

The estimators are counts ``(env, ctx, word, n)``, from a folder of environment files or any other lines with
an environment. Scores are computed per distinct item or position, from counts that are cut down to these
first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.measures import perplexity
from counterfact.operators.dictionary import TermDictionary
from counterfact.plans import cloze
from counterfact.plans.evaluation import eval_batches, join_frequent, masked_positions
from counterfact.staging import stage

POOLED, MEAN = fixed.METHODS


@dataclass(frozen=True)
class EnvModel:
    """Counts of every environment, their number, and the size of the vocabulary."""

    n_env: int
    dictionary: TermDictionary
    counts: DataFrame
    alpha: float
    vocab_size: int
    context: str = "left"

    @property
    def envs(self) -> DataFrame:
        """Names of the environments."""
        return self.counts.select("env").distinct()

    def logits(self, items: DataFrame, method: str) -> DataFrame:
        """Normalised logits ``(ctx, target, opposite, word, logit)`` under the pooled estimator, the mean of
        all, or the estimator of the environment of that name."""
        if method == MEAN:
            return cloze.normalised_mean(items, self.counts, self.n_env, self.alpha, self.vocab_size)
        counts, env = (cloze.pool_counts(self.counts), fixed.POOLED_ENV) if method == POOLED else (self.counts, method)
        scores = cloze.candidate_scores(items, counts, [env], self.alpha, self.vocab_size)
        return scores.select("ctx", "target", "opposite", "word", "logit")

    def line_bias(self, test_lines: DataFrame, methods: Sequence[str]) -> DataFrame:
        """Bias of every line with exactly one term, under each method."""
        items = stage(cloze.cell_items(test_lines, self.dictionary, self.context), "items")
        distinct = stage(cloze.distinct_items(items), "distinct_items")
        parts = []
        for method in methods:
            parts.append(cloze.pair_bias(self.logits(distinct, method)).withColumn("method", F.lit(method)))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        return items.join(scored, ["ctx", "target", "opposite"]).select(
            "doc_id", "line_no", "method", "target", "opposite", "bias"
        )

    def evaluate(self, lines: DataFrame, seed: int, methods: Sequence[str]) -> DataFrame:
        """Evaluation loss per method: the mean of the batch means, its token-weighted counterpart, perplexity."""
        positions = masked_positions(eval_batches(lines), seed, context=self.context, keep=("batch",))
        counted = stage(
            positions.groupBy("batch", "ctx", "word").agg(F.count(F.lit(1)).alias("n_positions")), "positions"
        )
        asked = stage(counted.groupBy("ctx", "word").agg(F.count(F.lit(1)).alias("n_rows")), "asked")
        # A position asks for one word; it takes the place of both words of an item.
        items = asked.select("ctx", F.col("word").alias("target"), F.col("word").alias("opposite"))
        results = []
        for method in methods:
            logits = self.logits(items, method).groupBy("ctx", "word").agg(F.max("logit").alias("logit"))
            losses = join_frequent(counted, stage(logits, "logits"), asked, ["ctx", "word"])
            weighted = F.sum(-F.col("logit") * F.col("n_positions"))
            per_batch = losses.groupBy("batch").agg(weighted.alias("_s"), F.sum("n_positions").alias("_n"))
            results.append(
                per_batch.agg(
                    F.avg(F.col("_s") / F.col("_n")).alias("eval_loss"),
                    (F.sum("_s") / F.sum("_n")).alias("token_loss"),
                    F.count(F.lit(1)).alias("n_batches"),
                ).select(F.lit(method).alias("method"), "eval_loss", "token_loss", "n_batches")
            )
        found = results[0]
        for result in results[1:]:
            found = found.unionByName(result)
        return found.withColumn("perplexity", perplexity(F.col("eval_loss")))


def fit_environments(
    env_lines: DataFrame,
    dictionary: TermDictionary,
    alpha: float,
    context: str = "left",
    asked: DataFrame | None = None,
) -> EnvModel:
    """One estimator per environment from rows ``(env, line)``; the counts are written once.

    With ``asked``, the model scores the contexts of this table alone; see ``cloze.fold_contexts``.
    There may be any number of environments: none of them is a column or a literal of a plan.
    """
    counts = stage(cloze.fit_per_env(env_lines, context, asked=asked), "env_counts")
    n_env = counts.agg(F.count_distinct("env")).first()[0]
    return EnvModel(n_env, dictionary, counts, alpha, cloze.vocabulary_size(counts, dictionary), context)
