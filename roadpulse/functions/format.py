"""Display helpers: labels, number and date formats, weekday names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the reference's output text.
# Weekday names, index 0 = Sunday.
WEEKDAY_NAMES = ["Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"]
# Bar colours of the speed histogram: congested bins, free-flow bins.
CONGESTED_COLOR = "#e53935"
FREE_COLOR = "#42a5f5"
# Bin label separator (en dash) and unit suffixes.
BIN_LABEL_SEPARATOR = "–"
SPEED_UNIT = " km/h"
PERCENT_UNIT = " %"
# Display names of the hotspot table columns.
HOTSPOT_DISPLAY_NAMES = {
    "GEOHASH": "Geohash",
    "avg_speed": "Ø km/h",
    "stau_pct": "Stau %",
    "messungen": "Messungen",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday_name(dow: Column | str) -> Column:
    """0-based weekday index to its name (NULL outside 0..6)."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.try_element_at(names, _c(dow) + F.lit(1))


def bin_label(bin_lower: Column | str, width: int = 10) -> Column:
    """``lo–hi`` with ``hi = lo + width - 1``; NULL bin gives a NULL label."""
    lo = _c(bin_lower).cast("int")
    return F.concat(lo.cast("string"), F.lit(BIN_LABEL_SEPARATOR), (lo + F.lit(width - 1)).cast("string"))


def thousands(col: Column | str) -> Column:
    """Integer with ``,`` thousands separators, no decimals."""
    return F.format_number(_c(col).cast("long"), 0)


def with_unit(col: Column | str, unit: str) -> Column:
    """Value text followed by a unit suffix."""
    return F.concat(_c(col).cast("string"), F.lit(unit))


def iso_day(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd")


def month_year(col: Column | str) -> Column:
    """``Jan 2024`` style (English month abbreviation)."""
    return F.date_format(_c(col), "MMM yyyy")
