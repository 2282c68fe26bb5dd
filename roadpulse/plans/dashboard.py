"""One dashboard view as a plan: every figure for a range and threshold.

Run one by one, the reports scan the table eight times. ``Page`` needs two
scans of the range instead:

* ``cells``: counts and vehicle sums per (month, weekday, hour, exact speed).
  Its size is bounded by the calendar and the speed domain (months x 168 x
  distinct speeds), not by the row count, and it does not depend on the
  threshold. KPIs, monthly trend, weekday x hour, hour of day, histogram and
  monthly vehicles are all re-aggregations of it, so a threshold change
  re-reads only the cells. Sums of integer partials are exact, so every figure
  equals the direct report.
* ``segments``: the per-segment aggregate behind the hotspot list and the map.
  One row per segment; both top-k lists are taken from it.

Both are persisted (memory, spilling to disk) for the life of the view; losing
an executor only recomputes the lost blocks from the scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct, round_half_away, speed_bin
from ..operators import reports
from ..operators.filters import DEFAULT_THRESHOLD, DateRange, check_range, check_threshold, normalize_range
from .rollup import cells_from_rollup
from .segment_rollup import covers, segment_stats_from_rollup
from ..schema import AVERAGE_SPEED, NUMBER_OF_VEHICLES



def cells(traffic: DataFrame, rng: DateRange | None) -> DataFrame:
    return (
        reports.in_range(traffic, rng)
        .groupBy("month_ts", "dow", "hour", AVERAGE_SPEED)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(NUMBER_OF_VEHICLES).alias("n_veh"),
            F.sum(NUMBER_OF_VEHICLES).alias("sum_veh"),
        )
    )


def _n() -> Column:
    return F.coalesce(F.sum("n"), F.lit(0)).cast("long")


def _avg_speed() -> Column:
    with_speed = F.when(F.col(AVERAGE_SPEED).isNotNull(), F.col("n"))
    total = F.sum(F.col(AVERAGE_SPEED).cast("long") * F.col("n"))
    return round_half_away(F.try_divide(total.cast("double"), F.sum(with_speed)), 1)


def _share(threshold: int) -> Column:
    hit = F.when(F.col(AVERAGE_SPEED) <= F.lit(int(threshold)), F.col("n")).otherwise(F.lit(0))
    return round_half_away(pct(F.sum(hit), _n()), 1)


def _avg_vehicles(digits: int) -> Column:
    return round_half_away(F.try_divide(F.sum("sum_veh").cast("double"), F.sum("n_veh")), digits)


class Page:
    """All figures of one view. With ``rollup`` (the store's rollup), the cell
    figures read the rollup rows of the range instead of the measurements;
    with ``segment_rollup``, the hotspot list and the map read the segment
    rollup for the months wholly inside the range and the measurements only
    for its edge months (for thresholds of the dashboard's domain)."""

    def __init__(
        self,
        traffic: DataFrame,
        rng: DateRange | None,
        threshold: int,
        persist: bool = True,
        rollup: DataFrame | None = None,
        segment_rollup: DataFrame | None = None,
        spans: dict[int, tuple] | None = None,
    ):
        self.traffic = traffic
        self.spans = spans
        self.persist = persist
        self._owns_cells = True
        self.rng = rng
        self.threshold = threshold
        self.segment_rollup = segment_rollup
        self._cells = cells(traffic, rng) if rollup is None else cells_from_rollup(rollup, rng)
        self._segments = self._segment_stats(threshold)
        if persist:
            self._cells = self._cells.persist(StorageLevel.MEMORY_AND_DISK)
            self._segments = self._segments.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        """Release what this page holds; the cells belong to the page they were
        made for."""
        if self.persist:
            self._segments.unpersist()
            if self._owns_cells:
                self._cells.unpersist()

    def _segment_stats(self, threshold: int) -> DataFrame:
        if self.segment_rollup is not None and covers(threshold):
            return segment_stats_from_rollup(self.segment_rollup, self.traffic, self.rng, threshold, self.spans)
        return reports.segment_stats(self.traffic, self.rng, threshold)

    def with_threshold(self, threshold: int) -> "Page":
        """Same range, new threshold: the cells are reused as they are, and stay
        until the page they were made for is closed."""
        page = Page.__new__(Page)
        page.traffic, page.rng, page.threshold = self.traffic, self.rng, threshold
        page.segment_rollup, page.spans, page.persist = self.segment_rollup, self.spans, self.persist
        page._cells, page._owns_cells = self._cells, False
        page._segments = page._segment_stats(threshold)
        if page.persist:
            page._segments = page._segments.persist(StorageLevel.MEMORY_AND_DISK)
        return page

    # -- figures from the cells ---------------------------------------------------
    def kpis(self) -> DataFrame:
        return self._cells.agg(
            _n().alias("total_rows"),
            _avg_speed().alias("avg_speed"),
            _share(self.threshold).alias("stau_pct"),
            _avg_vehicles(1).alias("avg_vehicles"),
            F.sum("sum_veh").alias("total_vehicles"),
        )

    def monthly_trend(self) -> DataFrame:
        return (
            self._cells.groupBy("month_ts")
            .agg(
                _avg_speed().alias("avg_speed"),
                _share(self.threshold).alias("stau_pct"),
                F.sum("sum_veh").alias("total_vehicles"),
            )
            .orderBy(F.col("month_ts").asc_nulls_last())
        )

    def weekday_hour(self) -> DataFrame:
        return (
            self._cells.groupBy("dow", "hour")
            .agg(_share(self.threshold).alias("stau_pct"))
            .orderBy(F.col("dow").asc_nulls_last(), F.col("hour").asc_nulls_last())
        )

    def hour_of_day(self) -> DataFrame:
        return (
            self._cells.groupBy("hour")
            .agg(_avg_speed().alias("avg_speed"), _share(self.threshold).alias("stau_pct"))
            .orderBy(F.col("hour").asc_nulls_last())
        )

    def speed_histogram(self) -> DataFrame:
        return (
            self._cells.groupBy(speed_bin(AVERAGE_SPEED).alias("speed_bin"))
            .agg(_n().alias("cnt"))
            .orderBy(F.col("speed_bin").asc_nulls_last())
        )

    def monthly_vehicles(self) -> DataFrame:
        return (
            self._cells.groupBy("month_ts")
            .agg(_avg_vehicles(2).alias("avg_vehicles"), F.sum("sum_veh").alias("total_vehicles"))
            .orderBy(F.col("month_ts").asc_nulls_last())
        )

    # -- figures from the segments ------------------------------------------------
    def hotspots(self) -> DataFrame:
        top = reports.worst_first(self._segments, reports.HOTSPOT_MIN_ROWS, reports.HOTSPOT_LIMIT)
        return top.select("GEOHASH", "lat", "lon", "messungen", "avg_speed", "stau_pct")

    def map_points(self) -> DataFrame:
        top = reports.worst_first(self._segments, reports.MAP_MIN_ROWS, reports.MAP_LIMIT)
        return top.select("lat", "lon", "stau_pct", "avg_speed", "messungen")

    def fetch(self, max_parallel: int = 8) -> dict:
        """All figures as pandas frames (S12). Each figure is a small aggregate
        and comes to the driver as Arrow batches (``toArrow``, whatever the
        session's Arrow setting for ``toPandas``), then becomes a pandas frame.
        The two shared aggregates are computed first, side by side; then the
        figure jobs, which only re-read them, run concurrently."""
        with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
            list(pool.map(lambda df: df.count(), [self._cells, self._segments]))
            figs = self.figures()
            futures = {name: pool.submit(lambda d=df: d.toArrow().to_pandas()) for name, df in figs.items()}
            return {name: f.result() for name, f in futures.items()}

    def figures(self) -> dict[str, DataFrame]:
        return {
            "kpis": self.kpis(),
            "monthly_trend": self.monthly_trend(),
            "weekday_hour": self.weekday_hour(),
            "hour_of_day": self.hour_of_day(),
            "speed_histogram": self.speed_histogram(),
            "hotspots": self.hotspots(),
            "map_points": self.map_points(),
            "monthly_vehicles": self.monthly_vehicles(),
        }


def data_bounds(traffic: DataFrame) -> tuple:
    """Q1 fetched as a pair of dates (S13: one row to the driver)."""
    row = reports.date_bounds(traffic).first()
    return row["d_min"], row["d_max"]


def open_view(
    traffic: DataFrame,
    date_value=None,
    threshold: int = DEFAULT_THRESHOLD,
    bounds: tuple | None = None,
    rollup: DataFrame | None = None,
    segment_rollup: DataFrame | None = None,
) -> Page:
    """The page flow: data bounds, the picked dates normalised to a closed
    range (two dates, one date until the end of the data, or one day), the
    threshold and range checked against their domains, then the page."""
    if bounds is None:
        if rollup is not None:
            from .rollup import bounds_from_rollup

            row = bounds_from_rollup(rollup).first()
            bounds = (row["d_min"], row["d_max"])
        else:
            bounds = data_bounds(traffic)
    rng = resolve_range(date_value, threshold, bounds)
    return Page(traffic, rng, threshold, rollup=rollup, segment_rollup=segment_rollup)


def resolve_range(date_value, threshold: int, bounds: tuple) -> DateRange:
    """The picked dates as a closed range (two dates, one date until the end
    of the data, or one day; nothing picked is the whole data), with the
    threshold and the range checked against their domains."""
    if bounds[0] is None:
        raise ValueError("the table holds no measurements")
    rng = normalize_range(bounds if date_value is None else date_value, bounds)
    check_threshold(threshold)
    check_range(rng, bounds)
    return rng
