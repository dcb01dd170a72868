"""Run tags: parameters of a run written into, and read back from, a file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from counterfact import fixed

# The two forms of a score file name.
WITH_RATE = r"^split(\d+)_p(\d+)_lr(\d+)[eE]?(-?\d*)_(eLM|iLM)\.csv"
WITHOUT_RATE = r"^split(\d+)_p(\d+)_(eLM|iLM)\.csv"


def run_tag(seed: Column, p_text: Column, rate_text: Column | None = None) -> Column:
    """Tag of a run; the numbers are given as text, so nothing depends on number formatting."""
    parts = [F.lit("split"), seed.cast("string"), F.lit("_p"), F.replace(p_text, F.lit("."), F.lit(""))]
    if rate_text is not None:
        parts += [F.lit("_lr"), F.replace(rate_text, F.lit("."), F.lit(""))]
    return F.concat(*parts)


def score_file(tag: Column, method: Column) -> Column:
    """Name of the score file of a run."""
    return F.concat(tag, F.lit("_"), method, F.lit(".csv"))


def parse_run_tag(name: Column, mode: str = "exact") -> Column:
    """Struct ``(seed, p_env_a, lr, method)``; NULL where the name does not match.

    ``exact`` puts the dot back after the first digit. ``compat`` reads the fraction of p and the
    rate as bare digits, which makes p ten times too small.
    """
    if mode not in ("exact", "compat"):
        raise ValueError(f"unknown mode: {mode}")
    rated = name.rlike(WITH_RATE)
    plain = name.rlike(WITHOUT_RATE)

    def group(with_rate: int, without_rate: int) -> Column:
        return F.when(rated, F.regexp_extract(name, WITH_RATE, with_rate)).when(
            plain, F.regexp_extract(name, WITHOUT_RATE, without_rate)
        )

    p_digits = group(2, 2)
    base = F.regexp_extract(name, WITH_RATE, 3)
    exponent = F.regexp_extract(name, WITH_RATE, 4)
    if mode == "exact":
        p_text, base_text = _dotted(p_digits), _dotted(base)
    else:
        p_text, base_text = F.concat(F.lit("0."), p_digits), base
    rate_text = F.when(
        rated, F.when(exponent == "", base_text).otherwise(F.concat(base_text, F.lit("e"), exponent))
    ).otherwise(F.lit(fixed.DEFAULT_RATE))
    p_env_a = p_text.try_cast("double")
    rate = rate_text.try_cast("double")
    return F.when(
        (rated | plain) & p_env_a.isNotNull() & rate.isNotNull(),
        F.struct(
            group(1, 1).try_cast("int").alias("seed"),
            p_env_a.alias("p_env_a"),
            rate.alias("lr"),
            group(5, 3).alias("method"),
        ),
    )


def _dotted(digits: Column) -> Column:
    rest = F.substring(digits, 2, 2147483647)
    return F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), rest)).otherwise(digits)
