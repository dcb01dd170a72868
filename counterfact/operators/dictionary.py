"""The dictionary of paired terms and the operators that look terms up in it."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text

# Terms that are a literal of the plan; a larger dictionary is sent to the tasks once and looked up there.
LITERAL_TERMS = 10_000
# Terms of a table that a join sends to all tasks.
BROADCAST_TERMS = 100_000
# Characters of a dictionary that is sent to the tasks.
MAX_CHARACTERS = 256 << 20


class TermDictionary:
    """Symmetric dictionary of paired terms, in lower case.

    Up to ``LITERAL_TERMS`` terms are part of the expressions. The expressions of a larger dictionary look whole
    batches of words up in a table that is broadcast once, whose size is checked; they give the same answers.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        opposites: dict[str, str] = {}
        for left, right in pairs:
            for term, opposite in ((left.lower(), right.lower()), (right.lower(), left.lower())):
                if opposites.get(term, opposite) != opposite:
                    raise ValueError(f"term with two opposites: {term}")
                opposites[term] = opposite
        if not opposites:
            raise ValueError("no paired terms given")
        size = sum(map(len, opposites)) * 2
        if size > MAX_CHARACTERS:
            raise ValueError(f"{size} characters of terms, more than {MAX_CHARACTERS}")
        self.opposites = opposites
        self._shared: tuple[str, object] | None = None

    @classmethod
    def from_text(cls, lines: str) -> "TermDictionary":
        """Dictionary from text with one pair a line."""
        return cls(tuple(line.split()) for line in lines.splitlines() if line.strip())

    @classmethod
    def gendered(cls) -> "TermDictionary":
        """The given list of gendered pairs."""
        return cls.from_text(fixed.PAIRED_TERMS)

    @classmethod
    def frequent(cls) -> "TermDictionary":
        """Pairs of frequent words."""
        return cls.from_text(fixed.FREQUENT_TERMS)

    @property
    def terms(self) -> list[str]:
        return list(self.opposites)

    def __len__(self) -> int:
        return len(self.opposites)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rows ``(term, opposite)``."""
        return spark.createDataFrame(self._table())

    def _table(self) -> pa.Table:
        return pa.table({"term": list(self.opposites), "opposite": list(self.opposites.values())})

    @property
    def is_literal(self) -> bool:
        return len(self.opposites) <= LITERAL_TERMS

    def opposites_of(self, word_array: Column) -> Column:
        """Opposites of an array of words, NULL for words that are no terms; for dictionaries of any size."""
        context = SparkSession.active().sparkContext
        if self._shared is None or self._shared[0] != context.applicationId:
            self._shared = (context.applicationId, context.broadcast(self._table()))
        return F.arrow_udf(_finder(self._shared[1]), "array<string>")(word_array)

    def contains(self, word: Column) -> Column:
        """Whether a word is a term."""
        return word.isin(self.terms) if self.is_literal else self.opposite(word).isNotNull()

    def opposite(self, word: Column) -> Column:
        """Opposite of a word; NULL for other words."""
        if not self.is_literal:
            return F.get(self.opposites_of(F.array(word)), F.lit(0))
        literal = F.create_map(*[F.lit(x) for pair in self.opposites.items() for x in pair])
        return F.when(self.contains(word), F.element_at(literal, word))

    def swap_token(self, token: Column) -> Column:
        """Opposite of a whole token, capital kept; other tokens unchanged."""
        return _in_place_of(token, self.opposite(F.lower(token)))

    def swap_line(self, line: Column) -> Column:
        """Line with every whole-token term swapped and whitespace runs collapsed."""
        tokens = text.blank_tokens(line)
        if self.is_literal:
            return F.array_join(F.transform(tokens, self.swap_token), " ")
        return F.array_join(F.zip_with(tokens, self.opposites_of(F.transform(tokens, F.lower)), _in_place_of), " ")

    def has_token(self, line: Column) -> Column:
        """Whether swapping changes a token of the line."""
        tokens = text.blank_tokens(F.lower(line))
        if self.is_literal:
            return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in self.terms]))
        return F.exists(self.opposites_of(tokens), lambda o: o.isNotNull())

    def hits(self, word_array: Column) -> Column:
        """Terms among the words, repetitions kept."""
        if self.is_literal:
            return F.filter(word_array, self.contains)
        found = F.zip_with(word_array, self.opposites_of(word_array), lambda w, o: F.when(o.isNotNull(), w))
        return F.filter(found, lambda w: w.isNotNull())


def _in_place_of(token: Column, opposite: Column) -> Column:
    """The opposite with the capital of the token; the token if there is no opposite."""
    return F.when(opposite.isNull(), token).otherwise(
        F.when(text.is_capitalised(token), text.capitalise(opposite)).otherwise(opposite)
    )


def _finder(table):
    """Function from arrays of words to arrays of their opposites; the table is taken apart once a task."""
    known: dict[str, str] = {}

    def find(words: pa.Array) -> pa.Array:
        if not known:
            known.update(zip(*(table.value[c].to_pylist() for c in ("term", "opposite")), strict=True))
        # Every distinct word of the batch is looked up once; the opposite of a null word is null.
        coded = words.flatten().cast(pa.string()).dictionary_encode()
        found = pa.array([known.get(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        ends = sizes.cumsum()
        offsets = pa.array([0, *ends.tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, found)

    return find


def dict_lookup(tokens: DataFrame, column: str, dictionary: TermDictionary, how: str = "inner") -> DataFrame:
    """Join tokens with the dictionary; one of up to ``BROADCAST_TERMS`` terms is sent to all tasks."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    terms = dictionary.frame(tokens.sparkSession).withColumnRenamed("term", column)
    return tokens.join(F.broadcast(terms) if len(dictionary) <= BROADCAST_TERMS else terms, column, how)


def swap_lines(lines: DataFrame, dictionary: TermDictionary, column: str = "line") -> DataFrame:
    """Swap the terms of every line."""
    return lines.withColumn(column, dictionary.swap_line(F.col(column)))


def swap_rate(lines: DataFrame, dictionary: TermDictionary, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of swapped tokens per term."""
    tokens = lines.select(*keys, F.explode(text.blank_tokens(F.col("line"))).alias("token")).select(
        *keys, F.lower("token").alias("term")
    )
    # Counted before they are looked up, so that a frequent word is one row of the join.
    counted = tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    return dict_lookup(counted, "term", dictionary).select(*keys, "term", "opposite", "n")


def single_hits(lines: DataFrame, dictionary: TermDictionary) -> DataFrame:
    """Lines with exactly one term, with that term and its opposite.

    The words come out of an ``explode`` of one element, below which no filter is moved, so a line is taken
    apart once.
    """
    split = F.array(F.struct(text.words(F.col("line")).alias("words")))
    return (
        lines.select("*", F.inline(split))
        .withColumn("found", dictionary.hits(F.col("words")))
        .where(F.size("found") == 1)
        .withColumn("target", F.get("found", F.lit(0)))
        .withColumn("opposite", dictionary.opposite(F.col("target")))
        .drop("found")
    )


def mask_hits(hits: DataFrame, dictionary: TermDictionary, mask: str = fixed.MASK) -> DataFrame:
    """Mask the target of every line and give the position of the first mask, counted from 1.

    A line of ``single_hits`` has one term of the dictionary and the words beside it, so the place of the
    target among the words is the place of the mask.
    """
    if dictionary.is_literal:
        masked = text.mask_words(F.col("line"), dictionary.terms, mask)
    else:
        masked = text.mask_word(F.col("line"), F.col("target"), mask)
    return hits.withColumn("masked", masked).withColumn("mask_pos", F.array_position("words", F.col("target")))
