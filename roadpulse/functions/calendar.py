"""Calendar columns derived from the zone-less measurement timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE_TIME


def _ts(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dow0(col: Column | str) -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday (Spark's ``dayofweek`` is 1-based)."""
    return (F.dayofweek(_ts(col)) - F.lit(1)).cast("int")


def month_start(col: Column | str) -> Column:
    """First instant of the month as ``timestamp_ntz``.

    Goes through ``date`` and ``trunc`` so no session time zone is involved.
    """
    return F.trunc(_ts(col).cast("date"), "month").cast("timestamp_ntz")


def day_start(col: Column | str) -> Column:
    """Midnight of the day as ``timestamp_ntz``."""
    return _ts(col).cast("date").cast("timestamp_ntz")


def calendar_columns(col: Column | str = DATE_TIME) -> dict[str, Column]:
    """The six derived columns stored next to every measurement."""
    ts = _ts(col)
    return {
        "year": F.year(ts).cast("int"),
        "month": F.month(ts).cast("int"),
        "hour": F.hour(ts).cast("int"),
        "dow": dow0(ts),
        "month_ts": month_start(ts),
        "day_ts": day_start(ts),
    }


def with_calendar(df: DataFrame, col: str = DATE_TIME) -> DataFrame:
    """Append ``year, month, hour, dow, month_ts, day_ts`` in one projection."""
    return df.withColumns(calendar_columns(col))
