"""Display forms of the reports, kept inside the plan instead of in pandas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.format import (
    CONGESTED_COLOR,
    FREE_COLOR,
    HOTSPOT_DISPLAY_NAMES,
    PERCENT_UNIT,
    SPEED_UNIT,
    bin_label,
    iso_day,
    month_year,
    thousands,
    weekday_name,
    with_unit,
)
from .filters import DateRange
from .metrics import rounded_share
from .reports import date_bounds, hotspots, in_range, kpis, speed_histogram

HOURS = list(range(24))


def date_bounds_display(traffic: DataFrame) -> DataFrame:
    """Q1 as text: both days as ISO dates and the data period as ``Mon YYYY – Mon YYYY``."""
    b = date_bounds(traffic)
    return b.select(
        iso_day("d_min").alias("d_min_text"),
        iso_day("d_max").alias("d_max_text"),
        F.concat(month_year("d_min"), F.lit(" – "), month_year("d_max")).alias("period"),
    )


def kpi_display(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q2b: the four tile texts (count with separators, units appended)."""
    k = kpis(traffic, rng, threshold)
    return k.select(
        thousands("total_rows").alias("total_rows_text"),
        with_unit("avg_speed", SPEED_UNIT).alias("avg_speed_text"),
        with_unit("stau_pct", PERCENT_UNIT).alias("stau_pct_text"),
        F.col("avg_vehicles").cast("string").alias("avg_vehicles_text"),
    )


def weekday_hour_matrix(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q4b: 7 x 24 matrix, rows named by weekday (Sunday first), one column per
    hour ``"0".."23"``, missing cells 0.

    All 24 hour columns are always present (the pivot values are given), so
    the schema does not depend on the data and no extra job looks for the
    distinct hours. The pivot aggregates the measurements per (weekday, hour)
    with a partial aggregate before the shuffle, then folds the at most 168
    cells into rows; it is not ordered before pivoting, so no sort precedes it.
    """
    hour_cols = [str(h) for h in HOURS]
    matrix = (
        in_range(traffic, rng)
        .groupBy("dow")
        .pivot("hour", HOURS)
        .agg(rounded_share(threshold))
        .na.fill(0.0, subset=hour_cols)
    )
    return matrix.orderBy(F.col("dow").asc_nulls_last()).select(
        weekday_name("dow").alias("weekday"), *[F.col(f"`{c}`") for c in hour_cols]
    )


def speed_histogram_labeled(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q6b: histogram with ``lo–hi`` labels and the congested/free class.

    The class compares the bin's lower bound with the threshold (``<=``), so at
    20 km/h the bin 20–29 counts as congested.
    """
    hist = speed_histogram(traffic, rng)
    congested = F.col("speed_bin") <= F.lit(int(threshold))
    return hist.select(
        "speed_bin",
        "cnt",
        bin_label("speed_bin").alias("label"),
        F.coalesce(congested, F.lit(False)).alias("congested"),
        F.when(congested, F.lit(CONGESTED_COLOR)).otherwise(F.lit(FREE_COLOR)).alias("color"),
    )


def hotspot_table(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q7b: four display columns of the hotspot list, in its order."""
    top = hotspots(traffic, rng, threshold)
    return top.select(*[F.col(src).alias(dst) for src, dst in HOTSPOT_DISPLAY_NAMES.items()])
