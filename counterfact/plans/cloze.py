"""Count-based cloze estimators: P(word | context) from the words of training lines.

The logit of a word after a context is ``ln(n + alpha) - ln(n_ctx + alpha * V)``, with ``n`` taken
from the pooled lines, or from the lines of one environment. Several environments are combined by the
mean of their logits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text
from counterfact.functions.measures import entropy_bias, pair_probability
from counterfact.operators.dictionary import TermDictionary, single_hits
from counterfact.staging import stage

CONTEXTS = ("left", "both")
# Contexts that are sent to the tasks which count words.
ASKED_CONTEXTS = 500_000


def context_pairs(word_array: Column, context: str = "left") -> Column:
    """Array of ``(ctx, word)`` for every word, with marks at the ends of the line.

    The longer of the zipped arrays leaves one pair without a word; ``explode_pairs`` drops it.
    """
    if context not in CONTEXTS:
        raise ValueError(f"unknown context: {context}")
    left = F.concat(F.array(F.lit(fixed.LINE_START)), word_array)
    if context == "left":
        return F.arrays_zip(left.alias("ctx"), word_array.alias("word"))
    right = F.concat(F.slice(word_array, F.lit(2), F.size(word_array)), F.array(F.lit(fixed.LINE_END)))
    both = F.zip_with(left, right, lambda l, r: F.concat_ws(" ", l, r))
    return F.arrays_zip(both.alias("ctx"), word_array.alias("word"))


def explode_pairs(df: DataFrame, words_column: str, keep: Sequence[str], context: str = "left") -> DataFrame:
    """One row per word of an array column: kept columns, ``ctx``, ``word``."""
    pairs = df.select(*keep, F.inline(context_pairs(F.col(words_column), context)))
    return pairs.where(F.col("word").isNotNull())


def line_pairs(lines: DataFrame, keep: Sequence[str] = (), context: str = "left") -> DataFrame:
    """``(ctx, word)`` rows of lines."""
    return explode_pairs(lines.select(*keep, text.words(F.col("line")).alias("words")), "words", keep, context)


def fold_contexts(pairs: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Pairs with NULL as context where ``asked``, rows with ``ctx``, does not have it.

    Scores need the counts after the contexts they are asked for, and of all other words only that they occur. So a
    word is counted once for all other contexts, and is still in the vocabulary. Nothing is folded when nothing is
    asked for, or more contexts than ``ASKED_CONTEXTS``.
    """
    if asked is None:
        return pairs
    listed = stage(asked.select(F.col("ctx").alias("_asked")).distinct(), "asked_contexts")
    if listed.count() > ASKED_CONTEXTS:
        return pairs
    columns = [F.col("_asked").alias("ctx") if c == "ctx" else F.col(c) for c in pairs.columns]
    return pairs.join(F.broadcast(listed), F.col("ctx") == F.col("_asked"), "left").select(*columns)


def fit_per_env(
    env_lines: DataFrame, context: str = "left", keys: Sequence[str] = (), asked: DataFrame | None = None
) -> DataFrame:
    """Counts ``(env, ctx, word, n)``: one estimator per environment (and further keys). With ``asked``, contexts
    are folded."""
    pairs = fold_contexts(line_pairs(env_lines, [*keys, "env"], context), asked)
    return pairs.groupBy(*keys, "env", "ctx", "word").agg(F.count(F.lit(1)).alias("n"))


def fit_pooled(env_lines: DataFrame, context: str = "left") -> DataFrame:
    """Counts ``(ctx, word, n)`` over all environments together."""
    return line_pairs(env_lines, (), context).groupBy("ctx", "word").agg(F.count(F.lit(1)).alias("n"))


def pool_counts(counts: DataFrame, env: str = fixed.POOLED_ENV) -> DataFrame:
    """Counts of one pooled environment from counts per environment."""
    pooled = counts.groupBy("ctx", "word").agg(F.sum("n").alias("n"))
    return pooled.select(F.lit(env).alias("env"), "ctx", "word", "n")


def vocabulary_size(counts: DataFrame, dictionary: TermDictionary) -> int:
    """Distinct training words and dictionary terms, and one entry for unknown words."""
    unlisted = counts.where(~dictionary.contains(F.col("word")))
    return unlisted.select("word").distinct().count() + len(dictionary) + 1


def hit_items(hits: DataFrame, context: str = "left") -> DataFrame:
    """Hits with the context of their target."""
    pos = F.array_position(F.col("words"), F.col("target"))
    pair = F.get(context_pairs(F.col("words"), context), (pos - 1).cast("int"))
    return hits.withColumn("ctx", pair["ctx"])


def distinct_items(items: DataFrame) -> DataFrame:
    """Distinct ``(ctx, target, opposite)`` with the number of lines; scores depend on nothing else."""
    return items.groupBy("ctx", "target", "opposite").agg(F.count(F.lit(1)).alias("n_lines"))


def candidate_scores(
    items: DataFrame, counts: DataFrame, envs: Sequence[str], alpha: float, vocab_size: int
) -> DataFrame:
    """Logit of target and opposite of every distinct item in every environment.

    A pair never seen in an environment keeps its row and gets the logit of an unseen word.
    """
    wanted = items.select(
        "ctx",
        "target",
        "opposite",
        F.explode(F.array("target", "opposite")).alias("word"),
    ).withColumn("env", F.explode(F.array(*[F.lit(e) for e in envs])))
    # The counts are cut down to the contexts and words of the items before anything else is done with them.
    here = counts.where(F.col("env").isin(list(envs)))
    asked = wanted.select("ctx", "word").distinct()
    found = here.join(asked, ["ctx", "word"], "left_semi")
    totals = (
        here.join(asked.select("ctx").distinct(), "ctx", "left_semi")
        .groupBy("env", "ctx")
        .agg(F.sum("n").alias("n_ctx"))
    )
    scored = wanted.join(found, ["env", "ctx", "word"], "left").join(totals, ["env", "ctx"], "left")
    n, n_ctx = F.coalesce("n", F.lit(0)), F.coalesce("n_ctx", F.lit(0))
    return scored.select(
        "env",
        "ctx",
        "target",
        "opposite",
        "word",
        n.alias("n"),
        n_ctx.alias("n_ctx"),
        (F.log(n + F.lit(alpha)) - F.log(n_ctx + F.lit(alpha * vocab_size))).alias("logit"),
    )


def env_head_score(scores: DataFrame, env: str) -> DataFrame:
    """Scores of the named environment's estimator."""
    return scores.where(F.col("env") == env)


def mean_head_score(scores: DataFrame) -> DataFrame:
    """Mean of the logits over the environments of ``candidate_scores``."""
    return scores.groupBy("ctx", "target", "opposite", "word").agg(F.avg("logit").alias("logit"))


def _mean_shares(contexts: DataFrame, counts: DataFrame, n_env: int, alpha: float) -> DataFrame:
    """Rows ``(ctx, word, m)`` of the words seen after the contexts in some environment: the mean over all
    environments of ``ln(n + alpha)``.

    An environment without the word adds ``ln(alpha)``. So the sum runs over the counts that there are, and the
    other environments enter as a number.
    """
    here = counts.join(contexts.select("ctx").distinct(), "ctx", "left_semi")
    more = F.sum(F.log(F.col("n") + F.lit(alpha)) - F.lit(math.log(alpha)))
    return here.groupBy("ctx", "word").agg((more / n_env + F.lit(math.log(alpha))).alias("m"))


def mean_logits(items: DataFrame, counts: DataFrame, n_env: int, alpha: float, vocab_size: int) -> DataFrame:
    """Mean of the logits of target and opposite over all ``n_env`` environments that ``counts`` holds.

    The work follows the counts, not the number of environments.
    """
    wanted = items.select("ctx", "target", "opposite", F.explode(F.array("target", "opposite")).alias("word"))
    unseen = math.log(alpha * vocab_size)
    here = counts.join(items.select("ctx").distinct(), "ctx", "left_semi")
    more = F.sum(F.log(F.col("n_ctx") + F.lit(alpha * vocab_size)) - F.lit(unseen))
    totals = here.groupBy("env", "ctx").agg(F.sum("n").alias("n_ctx"))
    totals = totals.groupBy("ctx").agg((more / n_env + F.lit(unseen)).alias("t"))
    shares = _mean_shares(items, counts, n_env, alpha)
    logit = F.coalesce("m", F.lit(math.log(alpha))) - F.coalesce("t", F.lit(unseen))
    scored = wanted.join(shares, ["ctx", "word"], "left").join(totals, "ctx", "left")
    return scored.select("ctx", "target", "opposite", "word", logit.alias("logit"))


def normalised_mean(items: DataFrame, counts: DataFrame, n_env: int, alpha: float, vocab_size: int) -> DataFrame:
    """As ``mean_logits``, less the logarithm of the sum of their exponentials over the vocabulary.

    The totals of the contexts cancel out. Words that no environment has seen after a context share one value,
    and enter the sum as a number.
    """
    wanted = items.select("ctx", "target", "opposite", F.explode(F.array("target", "opposite")).alias("word"))
    shares = _mean_shares(items, counts, n_env, alpha)
    seen = shares.groupBy("ctx").agg(F.sum(F.exp("m")).alias("g"), F.count(F.lit(1)).alias("n_seen"))
    sums = seen.select("ctx", F.log(F.col("g") + (F.lit(vocab_size) - F.col("n_seen")) * F.lit(alpha)).alias("z"))
    scored = wanted.join(shares, ["ctx", "word"], "left").join(sums, "ctx", "left")
    logit = F.coalesce("m", F.lit(math.log(alpha))) - F.coalesce("z", F.lit(math.log(alpha * vocab_size)))
    return scored.select("ctx", "target", "opposite", "word", logit.alias("logit"))


#: Columns of ``item_evidence`` beside the item.
EVIDENCE = ("envs", "n_target", "n_opposite", "n_ctx", "seen_sum", "n_seen")


def item_evidence(items: DataFrame, counts: DataFrame, n_env: int, alpha: float) -> DataFrame:
    """What the estimators know of every distinct ``(ctx, target, opposite)``, for scorers outside the plan.

    ``envs`` are the environments that have seen the context, with the counts of target, opposite and context
    beside each. ``seen_sum`` and ``n_seen`` are, over the words seen after the context in some environment, the
    sum of the exponentials of the mean of ``ln(n + alpha)``, and their number; a normaliser needs no more. The
    count rows of a context are not gathered. A context that no environment has seen has a row of NULLs.
    """
    items = items.select("ctx", "target", "opposite").distinct()
    asked = items.select("ctx", F.explode(F.array("target", "opposite")).alias("word")).distinct()
    found = counts.join(asked, ["ctx", "word"], "left_semi").select("env", "ctx", "word", "n")
    here = counts.join(items.select("ctx").distinct(), "ctx", "left_semi")
    totals = here.groupBy("env", "ctx").agg(F.sum("n").alias("n_ctx"))
    sides = [found.select("env", "ctx", F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in ("target", "opposite")]
    each = items.join(totals, "ctx").join(sides[0], ["env", "ctx", "target"], "left")
    each = each.join(sides[1], ["env", "ctx", "opposite"], "left")
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_target", "n_opposite")]
    known = each.groupBy("ctx", "target", "opposite").agg(
        F.array_sort(F.collect_list(F.struct(F.col("env").alias("envs"), *counted, "n_ctx"))).alias("_e")
    )
    known = known.select("ctx", "target", "opposite", *[F.col("_e")[c].alias(c) for c in EVIDENCE[:4]])
    shares = _mean_shares(items, counts, n_env, alpha)
    seen = shares.groupBy("ctx").agg(F.sum(F.exp("m")).alias("seen_sum"), F.count(F.lit(1)).alias("n_seen"))
    return items.join(known, ["ctx", "target", "opposite"], "left").join(seen, "ctx", "left")


def pair_bias(scores: DataFrame) -> DataFrame:
    """Bias of every item from the logits of its target and its opposite."""
    is_target = F.col("word") == F.col("target")
    pairs = scores.groupBy("ctx", "target", "opposite").agg(
        F.max(F.when(is_target, F.exp("logit"))).alias("p1"),
        F.max(F.when(~is_target, F.exp("logit"))).alias("p2"),
    )
    return (
        pairs.withColumn("p", pair_probability(F.col("p1"), F.col("p2")))
        .where(F.col("p").isNotNull())
        .withColumn("bias", entropy_bias(F.col("p")))
    )


def cell_items(test_lines: DataFrame, dictionary: TermDictionary, context: str = "left") -> DataFrame:
    """Lines with exactly one term, with target, opposite and context."""
    hits = hit_items(single_hits(test_lines, dictionary), context)
    return hits.select("doc_id", "line_no", "ctx", "target", "opposite")
