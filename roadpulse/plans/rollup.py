"""A rollup of the measurements that answers six of the nine figures for any
date range and threshold without reading the measurements.

Key: (day, hour, exact speed, ``tail``) where ``tail`` marks rows after the
last whole second of their day (``23:59:59.x``), which a range ending on that
day leaves out. Measures: row count, vehicle count and sum, earliest and
latest timestamp. Partitioned by ``year, month`` like the store.

Size per month is at most days x 24 x distinct speeds x 2, independent of how
many rows the month holds, so a dashboard on a very large store reads a few
hundred thousand rows per month of range instead of the month itself. KPIs,
monthly trend, weekday x hour, hour of day, histogram, monthly vehicles and the
date bounds come from it exactly: counts and integer sums add up, and a day
range is a predicate on (day, tail). Hotspots and map points need per-segment
figures (see segment_rollup.py).

The store keeps it current: a load's rows are rolled up into folders of their own, which
go with the load's or the month's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import day_start, dow0, month_start
from ..operators.filters import DateRange
from ..schema import AVERAGE_SPEED, DATE_TIME, NUMBER_OF_VEHICLES, PARTITION_COLUMNS, is_partitioned

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("day_ts", T.TimestampNTZType(), True),
        T.StructField("hour", T.IntegerType(), True),
        T.StructField(AVERAGE_SPEED, T.IntegerType(), True),
        T.StructField("tail", T.BooleanType(), True),
        T.StructField("n", T.LongType(), True),
        T.StructField("n_veh", T.LongType(), True),
        T.StructField("sum_veh", T.LongType(), True),
        T.StructField("t_min", T.TimestampNTZType(), True),
        T.StructField("t_max", T.TimestampNTZType(), True),
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
    ]
)
ROLLUP_COLUMNS = [f.name for f in ROLLUP_SCHEMA.fields]


def _last_second() -> Column:
    return F.expr("INTERVAL '0 23:59:59' DAY TO SECOND")


def build_rollup(traffic: DataFrame, partitions: list[str] = PARTITION_COLUMNS) -> DataFrame:
    """Roll measurements (store layout or fixture) up to the rollup key within their
    ``partitions`` (the store keeps each load's rows apart).

    One partial aggregate per task before the shuffle; the output has at most
    one row per key and partition.
    """
    day = day_start(DATE_TIME)
    return (
        traffic.groupBy(
            day.alias("day_ts"),
            F.col("hour"),
            F.col(AVERAGE_SPEED),
            (F.col(DATE_TIME) > day + _last_second()).alias("tail"),
            *partitions,
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(NUMBER_OF_VEHICLES).alias("n_veh"),
            F.sum(NUMBER_OF_VEHICLES).alias("sum_veh"),
            F.min(DATE_TIME).alias("t_min"),
            F.max(DATE_TIME).alias("t_max"),
        )
        .select(*[c for c in ROLLUP_COLUMNS if c not in PARTITION_COLUMNS], *partitions)
    )


def rollup_range(rng: DateRange | None, partition_bound: bool = True) -> Column:
    """The closed day range on rollup rows (same rows as ``DateRange.predicate``
    on the measurements), with the implied partition bound when asked for."""
    day = F.col("day_ts")
    if rng is None:
        return day.isNotNull()
    lo = F.lit(rng.start.isoformat()).cast("date").cast("timestamp_ntz")
    hi = F.lit(rng.end.isoformat()).cast("date").cast("timestamp_ntz")
    cond = (day >= lo) & (day <= hi) & ~((day == hi) & F.col("tail"))
    if partition_bound:
        ym = F.col("year") * F.lit(100) + F.col("month")
        cond = cond & ym.between(
            F.lit(rng.start.year * 100 + rng.start.month), F.lit(rng.end.year * 100 + rng.end.month)
        )
    return cond


def cells_from_rollup(rollup: DataFrame, rng: DateRange | None) -> DataFrame:
    """The page's cell layout (month, weekday, hour, speed, counts) from the
    rollup; rows of one cell may repeat, the figures add them up. The month
    bound is added for the store's rollup, whose ``year``/``month`` are
    partition columns."""
    return rollup.where(rollup_range(rng, is_partitioned(rollup.schema))).select(
        month_start("day_ts").alias("month_ts"),
        dow0("day_ts").alias("dow"),
        F.col("hour"),
        F.col(AVERAGE_SPEED),
        F.col("n"),
        F.col("n_veh"),
        F.col("sum_veh"),
    )


def bounds_from_rollup(rollup: DataFrame) -> DataFrame:
    """Q1 from the rollup."""
    return rollup.agg(F.min("t_min").cast("date").alias("d_min"), F.max("t_max").cast("date").alias("d_max"))


def month_spans(rollup: DataFrame, rng: DateRange) -> dict[int, tuple]:
    """First and last timestamp of the range's first and last month, by
    ``year*100+month``: at most two rows, from those two months' rollup."""
    ym = F.col("year") * F.lit(100) + F.col("month")
    ends = sorted({d.year * 100 + d.month for d in (rng.start, rng.end)})
    found = rollup.where(ym.isin(ends)).groupBy(ym.alias("ym")).agg(F.min("t_min").alias("a"), F.max("t_max").alias("b"))
    return {r["ym"]: (r["a"], r["b"]) for r in found.collect()}


__all__ = [
    "ROLLUP_SCHEMA",
    "ROLLUP_COLUMNS",
    "PARTITION_COLUMNS",
    "build_rollup",
    "rollup_range",
    "cells_from_rollup",
    "bounds_from_rollup",
    "month_spans",
]
