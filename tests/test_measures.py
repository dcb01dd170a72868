import math

import pytest
from pyspark.sql import functions as F

from counterfact.functions import measures, tags


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "p1, p2, p, bias",
    [(0.2, 0.2, 0.5, 0.0), (0.9, 0.1, 0.9, 0.531004), (0.1, 0.3, 0.25, 0.188722), (0.3, 0.0, 1.0, 1.0), (0.0, 0.3, 0.0, 1.0)],
)
def test_bias(spark, p1, p2, p, bias):
    got = value(spark, measures.pair_probability(F.lit(p1), F.lit(p2)))
    assert got == pytest.approx(p)
    assert value(spark, measures.entropy_bias(F.lit(got))) == pytest.approx(bias, abs=1e-6)
    assert value(spark, measures.entropy_bias(F.lit(1 - got))) == pytest.approx(bias, abs=1e-6)


def test_floor(spark):
    assert value(spark, measures.pair_probability(F.lit(4e-9), F.lit(4e-9))) is None
    assert value(spark, measures.pair_probability(F.lit(0.0), F.lit(0.0))) is None


def test_perplexity(spark):
    assert value(spark, measures.perplexity(F.lit(2.0))) == pytest.approx(math.exp(2))
    assert value(spark, measures.perplexity(F.lit(100.0))) == math.inf
    assert value(spark, measures.perplexity(F.lit(None).cast("double"))) is None


def test_rounding(spark):
    assert value(spark, measures.format4(F.lit(1.23456))) == "1.2346"
    assert value(spark, measures.format4(F.lit(None).cast("double"))) is None
    assert value(spark, measures.round4(F.lit(1.23456))) == 1.2346


@pytest.mark.parametrize("requested, limit, length", [(None, 512, 512), (None, 10**30, 1024), (2048, 4096, 2048), (128, 512, 128)])
def test_block_length(spark, requested, limit, length):
    wanted = F.lit(requested).cast("double")
    assert value(spark, measures.block_length(wanted, F.lit(float(limit)))) == length


@pytest.mark.parametrize(
    "name, exact, compat",
    [
        ("split0_p01_lr1e-05_eLM.csv", (0, 0.1, 1e-5, "eLM"), (0.01, 1e-5)),
        ("split3_p025_lr00001_iLM.csv", (3, 0.25, 1e-4, "iLM"), (0.025, 1.0)),
        ("split3_p05_lr15e-05_iLM.csv", (3, 0.5, 1.5e-5, "iLM"), (0.05, 1.5e-4)),
        ("split2_p09_iLM.csv", (2, 0.9, 1e-5, "iLM"), (0.09, 1e-5)),
        ("split2_p09_lr1e-_iLM.csv", None, None),
        ("junk.csv", None, None),
    ],
)
def test_run_tags(spark, name, exact, compat):
    got = value(spark, tags.parse_run_tag(F.lit(name)))
    loose = value(spark, tags.parse_run_tag(F.lit(name), "compat"))
    if exact is None:
        assert got is None and loose is None
    else:
        assert tuple(got) == exact
        assert (loose.p_env_a, loose.lr) == pytest.approx(compat)


def test_tag_round_trip(spark):
    for p, rate in (("0.1", "1e-05"), ("0.25", "0.0001"), ("0.9", "1.5e-05"), ("1.0", "0.5")):
        name = tags.score_file(tags.run_tag(F.lit(4), F.lit(p), F.lit(rate)), F.lit("iLM"))
        assert tuple(value(spark, tags.parse_run_tag(name))) == (4, float(p), float(rate), "iLM")
