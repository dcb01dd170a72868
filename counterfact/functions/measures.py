"""Scalar measures: probabilities, entropy bias, perplexity, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from counterfact import fixed


def pair_probability(p1: Column, p2: Column) -> Column:
    """Share of ``p1`` in the pair; NULL where the sum is below the floor."""
    total = p1 + p2
    return F.when(total >= fixed.PROBABILITY_FLOOR, F.try_divide(p1, total))


def entropy_bias(p: Column) -> Column:
    """One minus the binary entropy of ``p``."""
    sure = p.isin(0.0, 1.0)
    entropy = F.when(sure, F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return F.lit(1.0) - entropy


def perplexity(loss: Column) -> Column:
    """Exponential of the loss, infinite from the guard value on."""
    return F.when(loss < fixed.LOSS_GUARD, F.exp(loss)).when(loss.isNotNull(), F.lit(float("inf")))


def unguarded_perplexity(loss: Column) -> Column:
    """Exponential of the loss as the periodic evaluation takes it; NULL without a loss."""
    return F.exp(loss)


def round4(value: Column) -> Column:
    """Value rounded to the four decimals of the logs."""
    return F.round(value, 4)


def format4(value: Column) -> Column:
    """Value as text with four decimals; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string("%.4f", value))


def block_length(requested: Column, model_limit: Column) -> Column:
    """Block length from the wanted length and the limit of the model."""
    capped = F.least(model_limit, F.lit(fixed.MODEL_LENGTH_LIMIT))
    return F.when(requested.isNull(), capped).otherwise(F.least(requested, model_limit))
