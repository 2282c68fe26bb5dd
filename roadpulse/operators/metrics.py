"""Aggregate building blocks shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import mean_of_parts, pct, round_half_away, whole_parts
from ..schema import AVERAGE_SPEED


def row_count() -> Column:
    return F.count(F.lit(1))


def congested_flag(threshold: int, speed: str = AVERAGE_SPEED) -> Column:
    """1 when the speed is at or below the threshold, else 0 (a NULL speed is 0)."""
    return F.when(F.col(speed) <= F.lit(int(threshold)), F.lit(1)).otherwise(F.lit(0))


def congested_share(threshold: int, speed: str = AVERAGE_SPEED) -> Column:
    """Percentage of rows at or below the threshold; every row, NULL speed
    included, counts in the denominator."""
    return pct(F.sum(congested_flag(threshold, speed)), row_count())


def rounded_avg(col: str, digits: int) -> Column:
    return round_half_away(F.avg(col), digits)


def rounded_degrees(col: str, digits: int) -> Column:
    """Mean of a coordinate, the same for any order and partitioning of the rows."""
    return round_half_away(mean_of_parts(*[F.sum(p) for p in whole_parts(col)], F.count(col)), digits)


def rounded_share(threshold: int, digits: int = 1) -> Column:
    return round_half_away(congested_share(threshold), digits)
