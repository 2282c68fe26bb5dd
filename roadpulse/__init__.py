"""Hourly road-segment measurements on Spark: load monthly CSV files into a
partitioned Parquet store, keep it in step with the source folder, and answer
date-filtered congestion questions as DataFrames."""

from .operators.filters import DateRange, normalize_range
from .operators.present import hotspot_table, kpi_display, speed_histogram_labeled, weekday_hour_matrix
from .operators.reports import (
    date_bounds,
    hotspots,
    hour_of_day,
    kpis,
    map_points,
    monthly_trend,
    monthly_vehicles,
    speed_histogram,
    weekday_hour,
)

__all__ = [
    "DateRange",
    "normalize_range",
    "date_bounds",
    "kpis",
    "monthly_trend",
    "weekday_hour",
    "hour_of_day",
    "speed_histogram",
    "hotspots",
    "map_points",
    "monthly_vehicles",
    "kpi_display",
    "weekday_hour_matrix",
    "speed_histogram_labeled",
    "hotspot_table",
]
