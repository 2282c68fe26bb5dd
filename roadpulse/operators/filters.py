"""Date-range and parameter handling (the dashboard's two user inputs)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE_TIME, is_partitioned

DEFAULT_THRESHOLD = 20
THRESHOLD_MIN, THRESHOLD_MAX, THRESHOLD_STEP = 5, 60, 5


def to_date(value) -> dt.date:
    """Accept ``date``, ``datetime``, pandas ``Timestamp`` or ISO text."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime().date()
    return dt.date.fromisoformat(str(value)[:10])


@dataclass(frozen=True)
class DateRange:
    """Closed range of whole days, ``start 00:00:00`` to ``end 23:59:59``.

    The upper end is the last whole second of ``end``: a measurement at
    ``23:59:59.5`` on that day falls outside, as in the reference.
    """

    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start, end) -> "DateRange":
        return cls(to_date(start), to_date(end))

    @property
    def lower(self) -> str:
        return f"{self.start.isoformat()} 00:00:00"

    @property
    def upper(self) -> str:
        return f"{self.end.isoformat()} 23:59:59"

    def predicate(self, ts: str = DATE_TIME, partition_bound: bool = True) -> Column:
        """Row predicate on the timestamp.

        With ``partition_bound`` it also states the implied bound on the
        ``year``/``month`` partition columns as one expression, so a scan of the
        partitioned store lists only the months in range (``PartitionFilters``);
        Catalyst cannot derive that bound from the timestamp predicate alone.
        """
        c = F.col(ts)
        cond = (c >= F.lit(self.lower).cast("timestamp_ntz")) & (c <= F.lit(self.upper).cast("timestamp_ntz"))
        if partition_bound:
            ym = F.col("year") * F.lit(100) + F.col("month")
            lo = self.start.year * 100 + self.start.month
            hi = self.end.year * 100 + self.end.month
            cond = cond & ym.between(F.lit(lo), F.lit(hi))
        return cond

    def apply(self, df: DataFrame, ts: str = DATE_TIME) -> DataFrame:
        """Filter ``df`` to the range; the partition bound is added only when
        ``year``/``month`` are the store's partition columns (schema mark)."""
        return df.where(self.predicate(ts, partition_bound=is_partitioned(df.schema)))


def normalize_range(value, bounds: tuple) -> DateRange:
    """Turn the date picker's value into a closed range.

    Two dates are taken as given; a sequence with one date runs from it to the
    end of the data; a bare date is that single day.
    """
    _, d_max = bounds
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return DateRange.of(value[0], value[1])
    if isinstance(value, (list, tuple)) and len(value) == 1:
        return DateRange.of(value[0], d_max)
    return DateRange.of(value, value)


def check_threshold(threshold: int) -> int:
    """Threshold domain of the dashboard: 5..60 km/h in steps of 5."""
    t = int(threshold)
    if t != threshold or not THRESHOLD_MIN <= t <= THRESHOLD_MAX or (t - THRESHOLD_MIN) % THRESHOLD_STEP:
        raise ValueError(f"threshold must be one of {THRESHOLD_MIN}..{THRESHOLD_MAX} step {THRESHOLD_STEP}, got {threshold!r}")
    return t


def check_range(rng: DateRange, bounds: tuple) -> DateRange:
    """Dates must lie within the data bounds and be ordered."""
    lo, hi = (to_date(b) if b is not None else None for b in bounds)
    if rng.start > rng.end:
        raise ValueError(f"range start {rng.start} is after its end {rng.end}")
    if lo is not None and (rng.start < lo or rng.end > hi):
        raise ValueError(f"range {rng.start}..{rng.end} outside data bounds {lo}..{hi}")
    return rng
