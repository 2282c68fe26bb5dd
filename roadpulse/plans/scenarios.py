"""Load and sync steps registered as driver queries.

Each scenario starts from the measurement rows derived from the whole
``lineitem`` table. The file-name lists are built from the months present in
the data, so they grow with it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.filters import check_threshold, normalize_range
from ..schema import AVERAGE_SPEED, DATE_TIME, LATITUDE, LONGITUDE, RAW_COLUMNS
from ..session import configure, scratch_dir
from ..sources import files
from ..sources.fixture import traffic_fixture
from ..sources.manifest import StoreBusy
from ..sources.store import TrafficStore
from ..sources.sync import months_of, name_year, new_files, removed_files, sync, without_months
from ..streaming.pickup import pick_up

# Scenario parameters: files of years up to this one count as loaded before
# (new-file scenario); the files of this year are deleted (removal scenario).
LOADED_UNTIL_YEAR = 1997
REMOVED_YEAR = 1996
VIEW_THRESHOLD = 20
VIEW_FIGURES = ("kpis", "hotspots", "map_points")


def data_months(traffic: DataFrame) -> DataFrame:
    """One row per calendar month present in the data (at most twelve a year)."""
    return traffic.where(F.col("year").isNotNull()).select("year", "month").distinct()


def month_file_names(months: DataFrame) -> DataFrame:
    """``traffic_density_YYYYMM.csv`` for each (year, month) row."""
    name = F.concat(
        F.lit("traffic_density_"),
        F.lpad(F.col("year").cast("string"), 4, "0"),
        F.lpad(F.col("month").cast("string"), 2, "0"),
        F.lit(".csv"),
    )
    return months.select(name.alias("filename"))


def new_files_scenario(traffic: DataFrame) -> DataFrame:
    on_disk = month_file_names(data_months(traffic))
    manifest = on_disk.where(name_year(F.col("filename")) <= LOADED_UNTIL_YEAR)
    return new_files(on_disk, manifest).select("filename")


def removed_files_scenario(traffic: DataFrame) -> DataFrame:
    manifest = month_file_names(data_months(traffic))
    on_disk = manifest.where(name_year(F.col("filename")) != REMOVED_YEAR)
    gone = removed_files(manifest, on_disk)
    return without_months(traffic, months_of(gone))


def write_source_csv(traffic: DataFrame, folder: str, lead: str = "", **options) -> None:
    """The source columns as headed CSV files named by their month, like the real
    source's (``traffic_density_YYYYMM_<k>.csv``, after ``lead``): a rebalance shuffle by
    month (a large month becomes several files), then the files are moved to their
    names."""
    spark = traffic.sparkSession
    staged = f"{folder}-staged"
    ym = F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0"))
    rows = traffic.select(*RAW_COLUMNS, ym.alias("ym")).hint("rebalance", "ym")
    rows.write.option("header", True).options(**options).partitionBy("ym").csv(staged)
    for month in files.entries(spark, staged):
        parts = [e for e in files.entries(spark, month.path) if not files.hidden(e.name)] if month.is_dir else []
        for k, part in enumerate(parts):
            files.move(spark, part.path, folder, f"{lead}traffic_density_{month.name[3:]}_{k:05d}.csv")
    files.delete(spark, staged)


def write_mixed_csv(traffic: DataFrame, folder: str) -> None:
    """The measurements as files of several forms in one folder, by year: ISO dates and
    commas; day first, semicolons and decimal commas under names that begin with ``_``;
    year first with slashes and bars under names that begin with ``.``."""
    third = F.col("year") % 3
    write_source_csv(traffic.where(third == 0), folder)
    texts = {c: F.translate(F.col(c).cast("string"), ".", ",") for c in (LATITUDE, LONGITUDE)}
    day_first = traffic.where(third == 1).withColumns({**texts, DATE_TIME: F.date_format(DATE_TIME, "dd.MM.yyyy HH:mm")})
    write_source_csv(day_first, folder, "_", sep=";")
    year_first = traffic.where(third == 2).withColumn(DATE_TIME, F.date_format(DATE_TIME, "yyyy/MM/dd HH:mm:ss"))
    write_source_csv(year_first, folder, ".", sep="|")


def _of_year(spark: SparkSession, folder: str, chosen) -> list[files.Entry]:
    head = "traffic_density_"
    return [e for e in files.entries(spark, folder) if e.name.startswith(head) and chosen(int(e.name[len(head) :][:4]))]


def delete_source_files(spark: SparkSession, folder: str, year: int) -> int:
    """Delete the source files of a year; returns their number."""
    gone = _of_year(spark, folder, lambda y: y == year)
    for e in gone:
        files.delete(spark, e.path)
    return len(gone)


def set_aside(spark: SparkSession, folder: str, other: str, chosen) -> None:
    """Move the source files of the chosen years to another folder."""
    for e in _of_year(spark, folder, chosen):
        files.move(spark, e.path, other)


def _loaded_store(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, TrafficStore]:
    """A store loaded by ``sync`` from CSV files of the whole table."""
    configure(spark)
    base = scratch_dir(spark, name)
    write_source_csv(traffic_fixture(spark, sf_dir), f"{base}/data")
    store = TrafficStore(spark, f"{base}/store")
    sync(spark, f"{base}/data", store)
    return f"{base}/data", store


def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded_store(spark, sf_dir, "ingest")[1].table()


def _store_after_removal(spark: SparkSession, sf_dir: str, match: str) -> TrafficStore:
    """Load, delete the files of ``REMOVED_YEAR``, sync again."""
    folder, store = _loaded_store(spark, sf_dir, "removal")
    delete_source_files(spark, folder, REMOVED_YEAR)
    sync(spark, folder, store, match=match)
    return store


def removal_store(match: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _store_after_removal(spark, sf_dir, match).table()

    return run


def view_after_removal(figure: str):
    """A figure of the view on the rollups that ``sync`` keeps, after a removal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(_store_after_removal(spark, sf_dir, "month").view(None, VIEW_THRESHOLD), figure)()

    return run


def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    base = scratch_dir(spark, "stream")
    write_source_csv(traffic_fixture(spark, sf_dir), f"{base}/data")
    store = TrafficStore(spark, f"{base}/store")
    pick_up(spark, f"{base}/data", store, f"{base}/checkpoint")
    return store.table()


def _source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, TrafficStore]:
    """A scratch folder, the source files of the whole table in it, and a store."""
    configure(spark)
    base = scratch_dir(spark, name)
    write_source_csv(traffic_fixture(spark, sf_dir), f"{base}/data")
    return base, f"{base}/data", TrafficStore(spark, f"{base}/store")


def stream_after_lost_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files up to a year are picked up, the manifest is lost, the others come."""
    base, folder, store = _source(spark, sf_dir, "lost")
    set_aside(spark, folder, f"{base}/later", lambda y: y > LOADED_UNTIL_YEAR)
    pick_up(spark, folder, store, f"{base}/checkpoint")
    files.delete(spark, store.log.path)
    set_aside(spark, f"{base}/later", folder, lambda y: True)
    pick_up(spark, folder, store, f"{base}/checkpoint")
    return store.table()


def stream_after_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are picked up, those of a year removed by ``sync``, then put back."""
    base, folder, store = _source(spark, sf_dir, "return")
    pick_up(spark, folder, store, f"{base}/checkpoint")
    set_aside(spark, folder, f"{base}/aside", lambda y: y == REMOVED_YEAR)
    sync(spark, folder, store)
    set_aside(spark, f"{base}/aside", folder, lambda y: True)
    pick_up(spark, folder, store, f"{base}/checkpoint")
    return store.table()


def ingest_mixed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    base = scratch_dir(spark, "forms")
    write_mixed_csv(traffic_fixture(spark, sf_dir), f"{base}/data")
    store = TrafficStore(spark, f"{base}/store")
    sync(spark, f"{base}/data", store)
    return store.table()


def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as a table of the catalog, after a removal, asked in SQL."""
    base, folder, store = _source(spark, sf_dir, "catalog")
    store.table_name = "traffic_" + base.rsplit("-", 1)[-1]
    sync(spark, folder, store)
    delete_source_files(spark, folder, REMOVED_YEAR)
    sync(spark, folder, store, match="file")
    return spark.sql(
        f"SELECT year, month, count(*) AS n, sum(NUMBER_OF_VEHICLES) AS vehicles, max(AVERAGE_SPEED) AS fastest "
        f"FROM {store.table_name} WHERE year <= {LOADED_UNTIL_YEAR} GROUP BY year, month"
    )


def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sync while the first holds the store raises; the table is whole."""
    base, folder, store = _source(spark, sf_dir, "writers")
    with store.writing():
        try:
            sync(spark, folder, TrafficStore(spark, store.root))
        except StoreBusy:
            sync(spark, folder, store)
    return store.table()


def empty_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9: an empty folder is an error only before anything was loaded."""
    base, folder, store = _source(spark, sf_dir, "empty")

    def outcome(case: str, source: str) -> tuple[str, bool, int]:
        try:
            sync(spark, source, store)
        except FileNotFoundError:
            return case, True, 0
        return case, False, store.table().count()

    made = [outcome("nothing loaded yet", f"{base}/none"), outcome("files loaded", folder), outcome("all files removed", f"{base}/none")]
    return spark.createDataFrame(made, "case string, raised boolean, n long")


def in_order(df: DataFrame) -> DataFrame:
    """Rows of an ordered result as they come out of it (through Arrow), numbered."""
    result = df.toArrow()
    position = pa.array(range(1, len(result) + 1), pa.int64())
    return df.sparkSession.createDataFrame(result.append_column("position", position))


def ordered(name: str):
    """A report with its order as a column."""
    reports_of = {
        "monthly_trend": lambda t: reports.monthly_trend(t, None, VIEW_THRESHOLD),
        "weekday_hour": lambda t: reports.weekday_hour(t, None, VIEW_THRESHOLD),
        "hour_of_day": lambda t: reports.hour_of_day(t, None, VIEW_THRESHOLD),
        "speed_histogram": lambda t: reports.speed_histogram(t, None),
        "monthly_vehicles": lambda t: reports.monthly_vehicles(t, None),
        "hotspots": lambda t: reports.hotspots(t, None, VIEW_THRESHOLD),
        "map_points": lambda t: reports.map_points(t, None, VIEW_THRESHOLD),
    }
    return lambda t: in_order(reports_of[name](t))


def picked(pick):
    """KPIs of the range that a picked date stands for (F2)."""

    def run(traffic: DataFrame) -> DataFrame:
        first = reports.date_bounds(traffic).first()
        bounds = (first["d_min"], first["d_max"])
        return reports.kpis(traffic, normalize_range(pick(*bounds), bounds), VIEW_THRESHOLD)

    return run


PICKS = {
    "kpis_one_day": lambda lo, hi: lo + (hi - lo) // 2,
    "kpis_from_a_day": lambda lo, hi: (lo + (hi - lo) // 2,),
}


def threshold_domain(traffic: DataFrame) -> DataFrame:
    """which of the speeds in the data may be asked for as a threshold."""

    def accepted(speed: int) -> bool:
        try:
            return check_threshold(speed) == speed
        except ValueError:
            return False

    # Speeds are whole km/h: a few hundred values at most.
    speeds = [r[0] for r in traffic.select(AVERAGE_SPEED).where(f"{AVERAGE_SPEED} IS NOT NULL").distinct().collect()]
    return traffic.sparkSession.createDataFrame([(s, accepted(s)) for s in speeds], "threshold int, accepted boolean")


def via_rollup(traffic: DataFrame, rng, threshold: int, figure: str) -> DataFrame:
    """A dashboard figure computed from the rollup of the measurements."""
    from .dashboard import Page
    from .rollup import bounds_from_rollup, build_rollup
    from .segment_rollup import build_segment_rollup

    rollup = build_rollup(traffic)
    if figure == "date_bounds":
        return bounds_from_rollup(rollup)
    segments = build_segment_rollup(traffic) if figure in ("hotspots", "map_points") else None
    page = Page(traffic, rng, threshold, persist=False, rollup=rollup, segment_rollup=segments)
    return getattr(page, figure)()


def via_page(traffic: DataFrame, rng, threshold: int, figure: str) -> DataFrame:
    """A dashboard figure from the page's shared aggregates (cells of the range
    for the calendar figures, per-segment figures for hotspots and map)."""
    from .dashboard import Page

    return getattr(Page(traffic, rng, threshold, persist=False), figure)()


def _on_fixture(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(traffic_fixture(spark, sf_dir))

    return run


# Orders of the reports (O1 to O4) in SQL.
ORDERS = {
    "monthly_trend": "month_ts",
    "weekday_hour": "dow, hour",
    "hour_of_day": "hour",
    "speed_histogram": "speed_bin NULLS LAST",
    "monthly_vehicles": "month_ts",
    "hotspots": "stau_pct DESC NULLS LAST, GEOHASH NULLS LAST",
    "map_points": "stau_pct DESC NULLS LAST, GEOHASH NULLS LAST",
}
WHOLE_TABLE = ("ingest_roundtrip", "ingest_mixed_forms", "stream_roundtrip", "stream_after_lost_manifest", "stream_after_return", "sync_two_writers")


def registered():
    return {
        "sync_new_files": _on_fixture(new_files_scenario),
        "sync_removed_files": _on_fixture(removed_files_scenario),
        **{f"ordered_{n}": _on_fixture(ordered(n)) for n in ORDERS},
        **{n: _on_fixture(picked(p)) for n, p in PICKS.items()},
        "threshold_domain": _on_fixture(threshold_domain),
        **loads(),
    }


def loads():
    """Scenarios that load a store of their own."""
    return {
        "ingest_roundtrip": ingest_roundtrip,
        "ingest_mixed_forms": ingest_mixed_forms,
        "stream_roundtrip": stream_roundtrip,
        "stream_after_lost_manifest": stream_after_lost_manifest,
        "stream_after_return": stream_after_return,
        "catalog_table": catalog_table,
        "sync_two_writers": two_writers,
        "sync_empty_source": empty_sources,
        "sync_removal_store": removal_store("month"),
        "sync_removal_store_by_file": removal_store("file"),
        **{f"view_{f}_after_removal": view_after_removal(f) for f in VIEW_FIGURES},
    }


_NAMES = "SELECT DISTINCT printf('traffic_density_%04d%02d.csv', year, month) AS filename FROM traffic WHERE year IS NOT NULL"
_YEAR_OF = "TRY_CAST(regexp_extract({n}, '(\\d{{4}})(\\d{{2}})', 1) AS INT)"
_MONTH_OF = "TRY_CAST(regexp_extract({n}, '(\\d{{4}})(\\d{{2}})', 2) AS INT)"


def oracle():
    y = _YEAR_OF.format(n="filename")
    new_sql = f"""
, on_disk AS ({_NAMES}),
manifest AS (SELECT filename FROM on_disk WHERE {y} <= {LOADED_UNTIL_YEAR})
SELECT filename FROM on_disk d WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.filename = d.filename)"""
    removed_sql = f"""
, manifest AS ({_NAMES}),
on_disk AS (SELECT filename FROM manifest WHERE {y} <> {REMOVED_YEAR}),
gone AS (SELECT filename FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM on_disk d WHERE d.filename = m.filename)),
months AS (
  SELECT DISTINCT {y} AS year, {_MONTH_OF.format(n="filename")} AS month FROM gone
  WHERE {y} IS NOT NULL AND {_MONTH_OF.format(n="filename")} IS NOT NULL)
SELECT * FROM traffic t WHERE NOT EXISTS (SELECT 1 FROM months m WHERE m.year = t.year AND m.month = t.month)"""
    return {
        "sync_new_files": new_sql,
        "sync_removed_files": removed_sql,
        **{n: "SELECT * FROM traffic" for n in WHOLE_TABLE},
        "catalog_table": f"""
SELECT year, month, COUNT(*) AS n, CAST(SUM(NUMBER_OF_VEHICLES) AS BIGINT) AS vehicles, MAX(AVERAGE_SPEED) AS fastest
FROM traffic WHERE year <= {LOADED_UNTIL_YEAR} AND year <> {REMOVED_YEAR} GROUP BY year, month""",
        "sync_empty_source": """
SELECT 'nothing loaded yet' AS "case", true AS raised, 0::BIGINT AS n
UNION ALL SELECT 'files loaded', false, COUNT(*) FROM traffic
UNION ALL SELECT 'all files removed', false, 0""",
        "threshold_domain": f"""
SELECT DISTINCT AVERAGE_SPEED AS threshold, AVERAGE_SPEED BETWEEN 5 AND 60 AND AVERAGE_SPEED % 5 = 0 AS accepted
FROM traffic WHERE AVERAGE_SPEED IS NOT NULL""",
        "sync_removal_store": removed_sql,
        "sync_removal_store_by_file": removed_sql,
    }
