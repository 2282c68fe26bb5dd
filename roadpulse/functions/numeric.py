"""Numeric column helpers: rounding that matches the oracle, speed bins, safe shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(col: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` places: scale by 10^digits, round half away
    from zero, scale back.

    ``F.round`` rounds the shortest decimal text of the double (1.005 -> 1.01),
    while the reference engine rounds the scaled binary value (1.005 * 100 is
    100.49999999999999, so 1.0). The whole and fractional parts are taken with
    ``floor`` and ``%`` on the absolute value; both are exact in binary, so the
    half test is exact too. Pure Catalyst expressions, so it stays in codegen.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = F.lit(float(10**digits))
    scaled = c.cast("double") * scale
    mag = F.abs(scaled)
    frac = mag % F.lit(1.0)
    whole = mag - frac
    rounded = whole + F.when(frac >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(scaled < 0, -rounded).otherwise(rounded) / scale


# A coordinate in two whole parts: ten-thousandths of a degree, and hundred-billionths
# of what these leave. Sums of whole numbers do not depend on the order of the rows, and
# both parts of a third of 10^12 rows fit 64 bits. Values beyond ``WIDEST`` (no degrees) and
# those that are no numbers are summed as they are.
COARSE, FINE, WIDEST = 1e4, 1e11, 1e3
PARTS = ("coarse", "fine", "wide")


def whole_parts(col: Column | str) -> list[Column]:
    """``PARTS`` of a double: two longs, and the double itself if it is not of degrees."""
    c = F.col(col) if isinstance(col, str) else col
    inside = F.abs(c) <= F.lit(WIDEST)
    coarse = F.rint(c * F.lit(COARSE))
    fine = F.rint((c - coarse / F.lit(COARSE)) * F.lit(FINE))
    return [F.when(inside, coarse.cast("long")), F.when(inside, fine.cast("long")), F.when(~inside, c)]


def mean_of_parts(coarse: Column, fine: Column, wide: Column, n: Column) -> Column:
    """Mean from the sums of the parts; NULL for no values."""
    zero = F.lit(0)
    total = F.coalesce(coarse, zero) / F.lit(COARSE) + F.coalesce(fine, zero) / F.lit(FINE) + F.coalesce(wide, F.lit(0.0))
    return F.try_divide(total, n)


def speed_bin(col: Column | str, width: int = 10) -> Column:
    """Lower bound of the ``width`` km/h bin as a double (``floor(v / w) * w``)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.floor(c / F.lit(width)) * F.lit(width)).cast("double")


def pct(numerator: Column, denominator: Column) -> Column:
    """``numerator * 100.0 / denominator`` in double arithmetic; NULL on a zero
    denominator, as the reference engine does."""
    return F.try_divide(numerator * F.lit(100.0), denominator)
