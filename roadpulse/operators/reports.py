"""The dashboard's nine questions as DataFrame -> DataFrame functions.

Every report takes the measurement frame (stored table or fixture), an optional
``DateRange`` and, where the question needs it, the congestion threshold in
km/h. ``rng=None`` means the whole table: every row with a timestamp, which is
what the reference's default range (data minimum to maximum) selects.

Plan shape of each grouped report: Parquet scan with the range in
``PushedFilters`` (and ``PartitionFilters`` on the store) -> partial
``HashAggregate`` -> one ``Exchange`` of at most one row per group and map task
-> final ``HashAggregate``. Hot keys are collapsed by the partial aggregate
before the shuffle, so a segment or month holding a third of all rows costs one
row per map task on the reduce side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import speed_bin
from ..schema import AVERAGE_SPEED, DATE_TIME, GEOHASH, LATITUDE, LONGITUDE, NUMBER_OF_VEHICLES
from .filters import DateRange
from .metrics import rounded_avg, rounded_degrees, rounded_share, row_count

HOTSPOT_MIN_ROWS = 100
HOTSPOT_LIMIT = 50
MAP_MIN_ROWS = 50
MAP_LIMIT = 500


def in_range(traffic: DataFrame, rng: DateRange | None) -> DataFrame:
    """Apply the closed day range, or keep every row with a timestamp."""
    if rng is None:
        return traffic.where(F.col(DATE_TIME).isNotNull())
    return rng.apply(traffic)


def _asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def date_bounds(traffic: DataFrame) -> DataFrame:
    """Q1: earliest and latest measurement day (one row; NULLs on an empty table)."""
    return traffic.agg(
        F.min(DATE_TIME).cast("date").alias("d_min"),
        F.max(DATE_TIME).cast("date").alias("d_max"),
    )


def kpis(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q2: one row of headline figures. An empty range gives count 0 and NULLs."""
    return in_range(traffic, rng).agg(
        row_count().alias("total_rows"),
        rounded_avg(AVERAGE_SPEED, 1).alias("avg_speed"),
        rounded_share(threshold).alias("stau_pct"),
        rounded_avg(NUMBER_OF_VEHICLES, 1).alias("avg_vehicles"),
        F.sum(NUMBER_OF_VEHICLES).alias("total_vehicles"),
    )


def monthly_trend(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q3: per calendar month, ascending."""
    return (
        in_range(traffic, rng)
        .groupBy("month_ts")
        .agg(
            rounded_avg(AVERAGE_SPEED, 1).alias("avg_speed"),
            rounded_share(threshold).alias("stau_pct"),
            F.sum(NUMBER_OF_VEHICLES).alias("total_vehicles"),
        )
        .orderBy(_asc("month_ts"))
    )


def weekday_hour(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q4: congested share per (weekday, hour), ascending by both."""
    return (
        in_range(traffic, rng)
        .groupBy("dow", "hour")
        .agg(rounded_share(threshold).alias("stau_pct"))
        .orderBy(_asc("dow"), _asc("hour"))
    )


def hour_of_day(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Q5: mean speed and congested share per hour of day."""
    return (
        in_range(traffic, rng)
        .groupBy("hour")
        .agg(
            rounded_avg(AVERAGE_SPEED, 1).alias("avg_speed"),
            rounded_share(threshold).alias("stau_pct"),
        )
        .orderBy(_asc("hour"))
    )


def speed_histogram(traffic: DataFrame, rng: DateRange | None) -> DataFrame:
    """Q6: measurements per 10 km/h bin (lower bound as double), NULL bin last."""
    return (
        in_range(traffic, rng)
        .groupBy(speed_bin(AVERAGE_SPEED).alias("speed_bin"))
        .agg(row_count().alias("cnt"))
        .orderBy(_asc("speed_bin"))
    )


def segment_stats(traffic: DataFrame, rng: DateRange | None, threshold: int) -> DataFrame:
    """Per-segment figures behind the hotspot table and the map (not ordered)."""
    return (
        in_range(traffic, rng)
        .groupBy(GEOHASH)
        .agg(
            rounded_degrees(LATITUDE, 5).alias("lat"),
            rounded_degrees(LONGITUDE, 5).alias("lon"),
            row_count().alias("messungen"),
            rounded_avg(AVERAGE_SPEED, 1).alias("avg_speed"),
            rounded_share(threshold).alias("stau_pct"),
        )
    )


def worst_first(segments: DataFrame, min_rows: int, limit: int) -> DataFrame:
    """Segments with more than ``min_rows`` rows, highest share first, top ``limit``.

    Ties on the rounded share are broken by segment key so the cut is
    deterministic. Plans to ``TakeOrderedAndProject``: each partition keeps its
    own top ``limit`` and only those reach the single merging task.
    """
    return (
        segments.where(F.col("messungen") > F.lit(min_rows))
        .orderBy(F.col("stau_pct").desc_nulls_last(), _asc(GEOHASH))
        .limit(limit)
    )


def hotspots(
    traffic: DataFrame,
    rng: DateRange | None,
    threshold: int,
    limit: int = HOTSPOT_LIMIT,
    min_rows: int = HOTSPOT_MIN_ROWS,
) -> DataFrame:
    """Q7: ``GEOHASH, lat, lon, messungen, avg_speed, stau_pct`` of the worst segments."""
    segments = segment_stats(traffic, rng, threshold)
    return worst_first(segments, min_rows, limit).select(
        GEOHASH, "lat", "lon", "messungen", "avg_speed", "stau_pct"
    )


def map_points(
    traffic: DataFrame,
    rng: DateRange | None,
    threshold: int,
    limit: int = MAP_LIMIT,
    min_rows: int = MAP_MIN_ROWS,
) -> DataFrame:
    """Q8: map points ``lat, lon, stau_pct, avg_speed, messungen``; segment key dropped."""
    segments = segment_stats(traffic, rng, threshold)
    return worst_first(segments, min_rows, limit).select("lat", "lon", "stau_pct", "avg_speed", "messungen")


def monthly_vehicles(traffic: DataFrame, rng: DateRange | None) -> DataFrame:
    """Q9: vehicles per month: mean (2 decimals) and total, ascending."""
    return (
        in_range(traffic, rng)
        .groupBy("month_ts")
        .agg(
            rounded_avg(NUMBER_OF_VEHICLES, 2).alias("avg_vehicles"),
            F.sum(NUMBER_OF_VEHICLES).alias("total_vehicles"),
        )
        .orderBy(_asc("month_ts"))
    )


__all__ = [
    "date_bounds",
    "kpis",
    "monthly_trend",
    "weekday_hour",
    "hour_of_day",
    "speed_histogram",
    "segment_stats",
    "hotspots",
    "map_points",
    "monthly_vehicles",
    "in_range",
]
