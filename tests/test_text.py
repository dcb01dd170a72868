import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text
from counterfact.sources import corpus

TEXTS = st.lists(st.text(alphabet="aé ÉBß_9,.\t\xa0 'ñ", max_size=20), min_size=1, max_size=30)


def test_whitespace_is_pythons():
    assert set(fixed.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_strip_split_words_match_python(lines_of, texts):
    line = F.col("line")
    rows = (
        lines_of(texts)
        .select("doc_id", text.strip_line(line).alias("s"), text.blank_tokens(line).alias("t"), text.words(line).alias("w"))
        .collect()
    )
    for row in rows:
        source = texts[row.doc_id]
        assert row.s == source.strip()
        assert row.t == source.split()
        assert row.w == re.findall(r"\b\w+\b", source.lower())


def test_clean_lines_drops_blank(lines_of):
    kept = corpus.clean_lines(lines_of(["  a b ", "", " \t\xa0", "c"])).orderBy("doc_id").collect()
    assert [r.line for r in kept] == ["a b", "c"]


def test_mask_word(spark):
    df = spark.createDataFrame(
        [("He said, the éhe",), ("he HE hen",), ("he_ he",), ("Mr. X",), ("hers",)], "line string"
    )
    got = [r[0] for r in df.select(text.mask_words(F.col("line"), ["he", "hers", "mr", "mr."])).collect()]
    assert got == ["[MASK] said, the éhe", "[MASK] [MASK] hen", "he_ [MASK]", "[MASK]. X", "[MASK]"]


def test_mask_may_hold_special_characters(spark):
    df = spark.createDataFrame([("a he b", "he")], "line string, target string")
    mask = r"<$1\>"
    masked = df.select(text.mask_words(F.col("line"), ["he"], mask).alias("m"))
    assert masked.first().m == f"a {mask} b"
    assert masked.select(F.array_position(text.masked_tokens(F.col("m"), mask), mask)).first()[0] == 2


def test_text_column_pick(spark):
    named = spark.createDataFrame([("x", "y")], "a string, content string")
    first = spark.createDataFrame([("x", "y")], "a string, b string")
    assert corpus.text_column_pick(named).first().text == "y"
    assert corpus.text_column_pick(first).first().text == "x"


def test_blanks_are_the_same_characters(spark):
    """Every character is a blank of the tokens if it is one of the class of blanks."""
    ids = spark.range(0x110000).where("id < 55296 or id > 57343")
    chars = ids.select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32").alias("c"))
    blank, inside = F.col("c").rlike(text.SPACE_CLASS), F.size(text.blank_tokens(F.concat(F.lit("a"), "c", F.lit("b")))) == 2
    assert chars.where(blank != inside).count() == 0 and chars.where(blank).count() == 29
