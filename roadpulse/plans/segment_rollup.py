"""A per-segment, per-month rollup behind the hotspot list and the map.

Key: (segment, year, month). Measures: row count, counts and sums of speed,
latitude and longitude (in whole parts), and for every threshold of the dashboard's domain
(5..60 km/h in steps of 5) the number of rows at or below it. A month's rollup
has one row per segment and load, however many measurements the segment has
in that month (hourly data: about 720 per segment and month).

A day range is answered exactly: months that lie wholly inside the range are
read from the rollup, the at most two months at its edges from the measurement
rows with the range predicate (partition-pruned to those months), and the two
parts are added up per segment. A month counts as wholly inside only if its
last day is before the range's last day, since the range stops at
``23:59:59`` of that day, or if its first and last timestamps (``spans``, from
the calendar rollup) are known to lie inside. Thresholds outside the domain have no count column;
for them the per-segment figures are computed from the measurements.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import PARTS, mean_of_parts, pct, round_half_away, whole_parts
from ..operators.filters import THRESHOLD_MAX, THRESHOLD_MIN, THRESHOLD_STEP, DateRange
from ..operators.reports import in_range
from ..schema import AVERAGE_SPEED, GEOHASH, LATITUDE, LONGITUDE, PARTITION_COLUMNS

# One count column per threshold of the dashboard's domain.
THRESHOLDS = list(range(THRESHOLD_MIN, THRESHOLD_MAX + 1, THRESHOLD_STEP))


# The coordinates, by the name of their measures: a count and the sums of the parts that
# make a mean independent of the order of rows (``functions.numeric.whole_parts``).
SIDES = {"lat": LATITUDE, "lon": LONGITUDE}


def _parts(side: str) -> list[str]:
    return [f"{side}_{p}" for p in PARTS]


def _le(t: int) -> str:
    return f"le_{t}"


SEGMENT_ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField(GEOHASH, T.StringType(), True),
        T.StructField("n", T.LongType(), True),
        T.StructField("n_speed", T.LongType(), True),
        T.StructField("sum_speed", T.LongType(), True),
    ]
    + [
        T.StructField(name, T.DoubleType() if name.endswith("wide") else T.LongType(), True)
        for side in SIDES
        for name in (f"n_{side}", *_parts(side))
    ]
    + [T.StructField(_le(t), T.LongType(), True) for t in THRESHOLDS]
    + [T.StructField("year", T.IntegerType(), True), T.StructField("month", T.IntegerType(), True)]
)
SEGMENT_ROLLUP_COLUMNS = [f.name for f in SEGMENT_ROLLUP_SCHEMA.fields]
# Measures every figure needs, whatever the threshold.
BASE_MEASURES = ["n", "n_speed", "sum_speed"] + [c for side in SIDES for c in (f"n_{side}", *_parts(side))]


def _measures() -> list[Column]:
    """Rollup measures over measurement rows."""
    speed = F.col(AVERAGE_SPEED)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(speed).alias("n_speed"),
        F.sum(speed.cast("long")).alias("sum_speed"),
        *[
            m
            for side, c in SIDES.items()
            for m in (F.count(c).alias(f"n_{side}"), *[F.sum(p).alias(k) for p, k in zip(whole_parts(c), _parts(side))])
        ],
    ] + [F.count(F.when(speed <= F.lit(t), F.lit(1))).alias(_le(t)) for t in THRESHOLDS]


def build_segment_rollup(traffic: DataFrame, partitions: list[str] = PARTITION_COLUMNS) -> DataFrame:
    """Roll measurements up to (segment, year, month) or finer ``partitions``. One
    partial aggregate per task before the shuffle, so a hot segment costs one row per
    task."""
    own = [c for c in SEGMENT_ROLLUP_COLUMNS if c not in PARTITION_COLUMNS]
    return traffic.groupBy(GEOHASH, *partitions).agg(*_measures()).select(*own, *partitions)


def _row_measures(rows: DataFrame, threshold: int) -> DataFrame:
    """Each measurement row as a one-row contribution in the rollup's measure
    shape (for the range's edge months), so the edge rows and the rollup rows
    are added up by one aggregate."""
    speed = F.col(AVERAGE_SPEED)

    def flag(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")

    return rows.select(
        F.col(GEOHASH),
        F.lit(1).cast("long").alias("n"),
        flag(speed.isNotNull()).alias("n_speed"),
        speed.cast("long").alias("sum_speed"),
        *[
            m
            for side, c in SIDES.items()
            for m in (flag(F.col(c).isNotNull()).alias(f"n_{side}"), *[p.alias(k) for p, k in zip(whole_parts(c), _parts(side))])
        ],
        flag(speed <= F.lit(int(threshold))).alias(_le(threshold)),
    )


def _ym(d: dt.date) -> int:
    return d.year * 100 + d.month


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def month_split(
    rng: DateRange, spans: dict[int, tuple] | None = None
) -> tuple[tuple[int, int] | None, list[int], list[int]]:
    """Months (as ``year*100+month``) wholly inside the range by the calendar, as
    one closed interval or ``None``; the months at its edges whose rows all lie
    inside by ``spans`` (first and last timestamp of a month); and the edge
    months that may reach beyond it.

    Month ``m`` is wholly inside when its first day is on or after the range's
    first day and its last day is before the range's last day; the month of
    the last day is therefore always an edge month.
    """
    first_full = rng.start if rng.start.day == 1 else _next_month(rng.start)
    end_month = dt.date(rng.end.year, rng.end.month, 1)
    full = None
    if first_full < end_month:
        full = (_ym(first_full), _ym(end_month - dt.timedelta(days=1)))
    start_is_full = full is not None and rng.start.day == 1
    edges = sorted({_ym(rng.end)} | (set() if start_is_full else {_ym(rng.start)}))
    lower, upper = dt.datetime.fromisoformat(rng.lower), dt.datetime.fromisoformat(rng.upper)
    inside = [m for m in edges if m in (spans or {}) and spans[m][0] >= lower and spans[m][1] <= upper]
    return full, inside, [m for m in edges if m not in inside]


def covers(threshold: int) -> bool:
    """Whether the rollup holds a count column for this threshold."""
    return int(threshold) == threshold and int(threshold) in THRESHOLDS


def segment_stats_from_rollup(
    segment_rollup: DataFrame,
    traffic: DataFrame,
    rng: DateRange | None,
    threshold: int,
    spans: dict[int, tuple] | None = None,
) -> DataFrame:
    """Per-segment figures (as ``reports.segment_stats``) from the rollup for
    the months wholly inside the range and the measurements for the edges."""
    if not covers(threshold):
        raise ValueError(f"no rollup count for threshold {threshold!r}")
    need = [GEOHASH] + BASE_MEASURES + [_le(threshold)]
    ym = F.col("year") * F.lit(100) + F.col("month")
    if rng is None:
        parts = [segment_rollup.where(F.col("year").isNotNull() & F.col("month").isNotNull()).select(*need)]
    else:
        full, inside, edges = month_split(rng, spans)
        parts = []
        whole = F.lit(False) if full is None else ym.between(F.lit(full[0]), F.lit(full[1]))
        whole = whole | ym.isin(inside) if inside else whole
        if full is not None or inside:
            parts.append(segment_rollup.where(whole).select(*need))
        if edges:
            raw = in_range(traffic, rng).where(ym.isin(edges))
            parts.append(_row_measures(raw, threshold).select(*need))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # One aggregate for both parts: partial sums per task before the shuffle.
    sums = rows.groupBy(GEOHASH).agg(*[F.sum(c).alias(c) for c in need[1:]])
    return sums.select(
        F.col(GEOHASH),
        *[
            round_half_away(mean_of_parts(*[F.col(p) for p in _parts(side)], F.col(f"n_{side}")), 5).alias(side) for side in SIDES
        ],
        F.col("n").alias("messungen"),
        round_half_away(F.try_divide(F.col("sum_speed").cast("double"), F.col("n_speed")), 1).alias("avg_speed"),
        round_half_away(pct(F.col(_le(threshold)), F.col("n")), 1).alias("stau_pct"),
    )


__all__ = [
    "THRESHOLDS",
    "SEGMENT_ROLLUP_SCHEMA",
    "SEGMENT_ROLLUP_COLUMNS",
    "build_segment_rollup",
    "month_split",
    "covers",
    "segment_stats_from_rollup",
]
