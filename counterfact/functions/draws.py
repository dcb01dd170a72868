"""Draws in [0, 1) that depend only on their arguments, so recomputed tasks agree."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0


def digest(*parts: Column | str | int) -> Column:
    """Hex digest of the parts; four draws of 32 bits each can be taken from it."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def draw_from(hexdigest: Column, part: int = 0) -> Column:
    """Draw number ``part`` (0 to 3) of a digest."""
    digits = F.substring(hexdigest, 8 * part + 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_SPAN)


def unit_draw(*parts: Column | str | int) -> Column:
    """One draw for the given parts."""
    return draw_from(digest(*parts))


def digest_below(hexdigest: Column, share: float, part: int = 0) -> Column:
    """Whether a draw of a digest is below ``share``, by comparing hex digits in order of text."""
    border = math.ceil(share * _SPAN)
    if border >= _SPAN:
        return F.lit(True)
    digits = hexdigest if part == 0 else F.substring(hexdigest, 8 * part + 1, 8)
    return digits < F.lit(f"{border:08x}")


def draw_below(share: float, *parts: Column | str | int) -> Column:
    """Whether the draw for the given parts is below ``share``."""
    return digest_below(digest(*parts), share)
