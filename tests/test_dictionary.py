import pytest
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.operators import dictionary
from counterfact.operators.dictionary import TermDictionary, dict_lookup, mask_hits, single_hits, swap_lines, swap_rate

SMALL = TermDictionary([("he", "she"), ("mr.", "mrs."), ("hero", "heroine"), ("king", "queen")])


def test_given_list():
    terms = TermDictionary.gendered()
    assert len(fixed.PAIRED_TERMS.split()) == 86 and len(terms) == 86
    assert all(terms.opposites[terms.opposites[t]] == t for t in terms.terms)


def test_conflicting_pairs_are_rejected():
    with pytest.raises(ValueError):
        TermDictionary([("a", "b"), ("a", "c")])
    with pytest.raises(ValueError):
        TermDictionary([])


@pytest.mark.parametrize(
    "line, swapped",
    [
        ("He said he", "She said she"),
        ("he, she", "he, he"),
        ("MR.  HERO x", "Mrs. Heroine x"),
        ("hERO", "heroine"),
        ("", ""),
        ("HE", "She"),
        ("a\xa0he", "a she"),
    ],
)
def test_swap(lines_of, line, swapped):
    assert swap_lines(lines_of([line]), SMALL).first().line == swapped
    assert lines_of([line]).select(SMALL.has_token(F.col("line"))).first()[0] == (swapped != " ".join(line.split()))


def test_swapping_twice_gives_the_line_back(lines_of):
    lines = ["He met the Queen", "a  hero and she", "mr. x"]
    twice = swap_lines(swap_lines(lines_of(lines), SMALL), SMALL).orderBy("doc_id").collect()
    assert [r.line for r in twice] == [" ".join(x.split()) for x in lines]


def test_swap_rate(lines_of):
    rows = swap_rate(lines_of(["He he, she", "mr. King"]), SMALL).collect()
    assert {(r.term, r.opposite): r.n for r in rows} == {
        ("he", "she"): 1, ("she", "he"): 1, ("mr.", "mrs."): 1, ("king", "queen"): 1,
    }


def test_single_hits(lines_of):
    lines = ["He's here", "he and he", "the queen", "Mr. X", "éhe", "he she"]
    got = {r.doc_id: (r.target, r.opposite) for r in single_hits(lines_of(lines), SMALL).collect()}
    assert got == {0: ("he", "she"), 2: ("queen", "king")}


def test_mask_position(lines_of):
    rows = mask_hits(single_hits(lines_of(["so He's here", "the queen"]), SMALL), SMALL).orderBy("doc_id").collect()
    assert [(r.masked, r.mask_pos) for r in rows] == [("so [MASK]'s here", 2), ("the [MASK]", 2)]


def test_lookup_keeps_or_drops(spark):
    tokens = spark.createDataFrame([("he",), ("x",)], "token string")
    assert {tuple(r) for r in dict_lookup(tokens, "token", SMALL).collect()} == {("he", "she")}
    assert {tuple(r) for r in dict_lookup(tokens, "token", SMALL, "left").collect()} == {("he", "she"), ("x", None)}


@pytest.fixture(params=["literal", "sent"])
def either(request, monkeypatch):
    """The small dictionary as a part of the plan, and sent to the tasks."""
    if request.param == "sent":
        monkeypatch.setattr(dictionary, "LITERAL_TERMS", 0)
        monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 0)
    return TermDictionary(list(SMALL.opposites.items()))


def test_both_forms_give_the_same(lines_of, either):
    lines = ["He met the Queen, mr. x", "", None, "MR.  HERO x\xa0he", "éhe he", "HERO", "so He's here", "ǆ queen", "x (KING) y"]
    table = lines_of(lines, 3)
    assert {r.doc_id: r.line for r in swap_lines(table, either).collect()} == {
        0: "She met the Queen, mrs. x", 1: "", 2: None, 3: "Mrs. Heroine x she", 4: "éhe she", 5: "Heroine",
        6: "so He's here", 7: "ǆ king", 8: "x (KING) y",
    }
    touched = table.select("doc_id", either.has_token(F.col("line")).alias("t")).collect()
    assert {r.doc_id for r in touched if r.t} == {0, 3, 4, 5, 7}
    found = mask_hits(single_hits(table, either), either).collect()
    assert {r.doc_id: (r.target, r.opposite, r.masked, r.mask_pos) for r in found} == {
        4: ("he", "she", "éhe [MASK]", 2), 5: ("hero", "heroine", "[MASK]", 1), 6: ("he", "she", "so [MASK]'s here", 2),
        7: ("queen", "king", "ǆ [MASK]", 2), 8: ("king", "queen", "x ([MASK]) y", 2),
    }
    assert {(r.term, r.n) for r in swap_rate(table, either).collect()} == {("he", 3), ("mr.", 2), ("hero", 2), ("queen", 1)}
    words = table.select(F.explode(F.split(F.lower("line"), " ")).alias("w"))
    assert {r.w for r in words.where(either.contains(F.col("w"))).collect()} == {"he", "mr.", "hero", "queen"}


def test_a_million_terms(spark, lines_of):
    """A dictionary of any size swaps, finds and counts, without being a literal of the plan."""
    many = TermDictionary([(f"left{i}", f"right{i}") for i in range(500_000)])
    assert len(many) == 1_000_000
    table = lines_of(["Left499999 x right7", "none here", "only LEFT123456, alone"] * 50, 4)
    assert {r.line for r in swap_lines(table, many).collect()} == {
        "Right499999 x left7", "none here", "only LEFT123456, alone",
    }
    plan = swap_lines(table, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "left7" not in plan and len(plan) < 20_000
    assert {(r.target, r.opposite) for r in single_hits(table, many).collect()} == {("left123456", "right123456")}
    assert {(r.term, r.opposite, r.n) for r in swap_rate(table, many).collect()} == {
        ("left499999", "right499999", 50), ("right7", "left7", 50),
    }
