"""Line and word functions, with Python's notion of whitespace and word characters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from counterfact import fixed

SPACE_CLASS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters; visible ASCII characters are told apart by one comparison.
_BLANKS = r"[[^\x{21}-\x{7E}]&&" + SPACE_CLASS + "]+"
WORD_CLASS = r"[\p{L}\p{N}_]"


def strip_line(line: Column) -> Column:
    """Line without whitespace at its ends."""
    return F.btrim(line, F.lit(fixed.WHITESPACE))


def blank_tokens(line: Column) -> Column:
    """Tokens between whitespace runs; an empty array for a blank line."""
    stripped = strip_line(line)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, _BLANKS)
    )


def words(line: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(line), F.lit(f"{WORD_CLASS}+"), F.lit(0))


def masked_tokens(line: Column, mask: str = fixed.MASK) -> Column:
    """Words of a masked line, the mask kept as one token."""
    pattern = f"{_quote_pattern(mask)}|{WORD_CLASS}+"
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def mask_words(line: Column, terms: Sequence[str], mask: str = fixed.MASK) -> Column:
    """Replace every term that stands as a whole word, in any case, by the mask.

    One constant pattern holds all terms. Terms that are not words, with a dot for example, never stand as one.
    """
    whole = [t for t in terms if re.fullmatch(r"\w+", t)]
    choice = "|".join(_quote_pattern(t) for t in sorted(whole, key=len, reverse=True))
    pattern = f"(?iu)(?<!{WORD_CLASS})(?:{choice or '(?!)'})(?!{WORD_CLASS})"
    return F.regexp_replace(line, F.lit(pattern), F.lit(mask.replace("\\", "\\\\").replace("$", "\\$")))


def mask_word(line: Column, word: Column, mask: str = fixed.MASK) -> Column:
    """Replace a column's word, where it stands as a whole word, in any case, by the mask."""
    pattern = F.concat(F.lit(f"(?iu)(?<!{WORD_CLASS})"), word, F.lit(f"(?!{WORD_CLASS})"))
    return F.regexp_replace(line, pattern, F.lit(mask.replace("\\", "\\\\").replace("$", "\\$")))


def is_capitalised(token: Column) -> Column:
    """Whether the first character is an upper-case letter."""
    return F.substring(token, 1, 1).rlike(r"^\p{Lu}")


def capitalise(token: Column) -> Column:
    """Token with its first character in upper case."""
    return F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 2147483647))


def _quote_pattern(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in text)
