"""


Every query starts from the same measurement rows, derived from the whole
``lineitem`` table (FIXTURES.md section 4); the oracle starts from the same rows
through the ``traffic`` CTE below.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadpulse.functions.format import HOTSPOT_DISPLAY_NAMES, WEEKDAY_NAMES  # noqa: E402
from roadpulse.operators import present, reports  # noqa: E402
from roadpulse.operators.filters import DateRange  # noqa: E402
from roadpulse.session import configure  # noqa: E402
from roadpulse.sources.fixture import traffic_fixture  # noqa: E402

# The training-data operators live in a subpackage of their own; without it, and
# without the pipeline at the repository top, the other queries stand alone.
LLM_MODULES = ("roadpulse.llm", "corpus_pipeline")


def _llm():
    """Queries and oracle SQL of the training-data operators and the pipeline."""
    try:
        import corpus_pipeline
        from roadpulse.llm import queries as llm_queries
    except ModuleNotFoundError as e:
        if e.name is None or not e.name.startswith(LLM_MODULES):
            raise
        return {}, {}
    q, sql = llm_queries.registered(), llm_queries.oracle()
    q["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return q, sql


SMOKE_DIR = "/root/testdata/sf0.001"

THRESHOLD = 20
RANGE = DateRange.of("1997-01-01", "1999-12-31")
EMPTY_RANGE = DateRange.of("1980-01-01", "1980-12-31")
# Ranges that start and end inside a month (segment rollup: edge months come
# from the measurements, whole months from the rollup).
MID_RANGE = DateRange.of("1995-03-15", "2001-10-20")
MID_RANGE_SHORT = DateRange.of("1997-03-15", "1999-10-20")


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return traffic_fixture(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the hotspot list over the whole table at sf0.001."""
    return reports.hotspots(_traffic(spark, SMOKE_DIR), None, THRESHOLD)


def _q(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_traffic(spark, sf_dir))

    return run


def dashboard_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from roadpulse.plans import scenarios

    q = {
        "date_bounds": _q(lambda t: reports.date_bounds(t)),
        "date_bounds_display": _q(lambda t: present.date_bounds_display(t)),
        "derive_calendar": _q(lambda t: t),
        "range_filter": _q(lambda t: reports.in_range(t, RANGE)),
        "kpis": _q(lambda t: reports.kpis(t, RANGE, THRESHOLD)),
        "kpis_empty_range": _q(lambda t: reports.kpis(t, EMPTY_RANGE, THRESHOLD)),
        "kpis_full_threshold_40": _q(lambda t: reports.kpis(t, None, 40)),
        "monthly_trend": _q(lambda t: reports.monthly_trend(t, RANGE, THRESHOLD)),
        "weekday_hour": _q(lambda t: reports.weekday_hour(t, RANGE, THRESHOLD)),
        "weekday_hour_matrix": _q(lambda t: present.weekday_hour_matrix(t, RANGE, THRESHOLD)),
        "hour_of_day": _q(lambda t: reports.hour_of_day(t, RANGE, THRESHOLD)),
        "speed_histogram": _q(lambda t: reports.speed_histogram(t, None)),
        "speed_histogram_labeled": _q(lambda t: present.speed_histogram_labeled(t, None, THRESHOLD)),
        "hotspots": _q(lambda t: reports.hotspots(t, None, THRESHOLD)),
        "hotspots_threshold_45": _q(lambda t: reports.hotspots(t, None, 45)),
        "hotspot_table": _q(lambda t: present.hotspot_table(t, None, THRESHOLD)),
        "map_points": _q(lambda t: reports.map_points(t, None, THRESHOLD)),
        "map_points_range": _q(lambda t: reports.map_points(t, RANGE, THRESHOLD)),
        "monthly_vehicles": _q(lambda t: reports.monthly_vehicles(t, RANGE)),
        "kpi_display": _q(lambda t: present.kpi_display(t, RANGE, THRESHOLD)),
    }
    q.update(scenarios.registered())
    q.update(
        {
            "rollup_date_bounds": _q(lambda t: scenarios.via_rollup(t, None, THRESHOLD, "date_bounds")),
            "rollup_kpis": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "kpis")),
            "rollup_monthly_trend": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "monthly_trend")),
            "rollup_weekday_hour": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "weekday_hour")),
            "rollup_hour_of_day": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "hour_of_day")),
            "rollup_speed_histogram": _q(lambda t: scenarios.via_rollup(t, None, THRESHOLD, "speed_histogram")),
            "rollup_monthly_vehicles": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "monthly_vehicles")),
            "rollup_hotspots": _q(lambda t: scenarios.via_rollup(t, None, THRESHOLD, "hotspots")),
            "rollup_hotspots_mid_range": _q(lambda t: scenarios.via_rollup(t, MID_RANGE, THRESHOLD, "hotspots")),
            "rollup_map_points": _q(lambda t: scenarios.via_rollup(t, RANGE, THRESHOLD, "map_points")),
            "rollup_map_points_mid_range": _q(
                lambda t: scenarios.via_rollup(t, MID_RANGE_SHORT, THRESHOLD, "map_points")
            ),
        }
    )
    # The dashboard page: calendar figures from one cell aggregate of the
    # range, hotspots and map from one per-segment aggregate.
    q.update(
        {
            f"page_{figure}": _q(lambda t, figure=figure, rng=rng: scenarios.via_page(t, rng, THRESHOLD, figure))
            for figure, rng in PAGE_FIGURES.items()
        }
    )
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query: the dashboard's and the training-data operators'."""
    return dashboard_queries() | _llm()[0]


# Page figures registered as queries, with the range each one is asked for
# (hotspots over the whole table: no segment passes 100 rows in 1997-1999).
PAGE_FIGURES = {
    "kpis": RANGE,
    "monthly_trend": RANGE,
    "weekday_hour": RANGE,
    "hour_of_day": RANGE,
    "speed_histogram": RANGE,
    "monthly_vehicles": RANGE,
    "hotspots": None,
    "map_points": RANGE,
}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB dialect).

TRAFFIC_CTE = """
WITH traffic_raw AS (
  SELECT
    l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT))            AS DATE_TIME,
    40.8e0 + ((l_partkey // 3) % 400) * 0.001e0                     AS LATITUDE,
    28.5e0 + ((l_partkey // 3) % 900) * 0.001e0                     AS LONGITUDE,
    'sx' || lpad(CAST(l_partkey // 3 AS VARCHAR), 6, '0')           AS GEOHASH,
    CAST(greatest(2 * l_quantity - 10, 0) AS INT)                   AS MINIMUM_SPEED,
    CAST(2 * l_quantity + 5 + l_linenumber AS INT)                  AS MAXIMUM_SPEED,
    CAST(2 * l_quantity AS INT)                                     AS AVERAGE_SPEED,
    CAST(l_suppkey % 97 + l_linenumber AS INT)                      AS NUMBER_OF_VEHICLES
  FROM lineitem
),
traffic AS (
  SELECT *,
    CAST(EXTRACT(year  FROM DATE_TIME) AS INT) AS year,
    CAST(EXTRACT(month FROM DATE_TIME) AS INT) AS month,
    CAST(EXTRACT(hour  FROM DATE_TIME) AS INT) AS hour,
    CAST(EXTRACT(dow   FROM DATE_TIME) AS INT) AS dow,
    DATE_TRUNC('month', DATE_TIME)             AS month_ts,
    DATE_TRUNC('day',   DATE_TIME)             AS day_ts
  FROM traffic_raw
)
"""

FULL = "DATE_TIME IS NOT NULL"

# The figures' definitions below, their column names (stau_pct and
# messungen among them), limits and group sizes are those of the dashboard that
# the results have to equal; as the tests' independent side, they state them.


def _range(r: DateRange) -> str:
    return f"DATE_TIME >= TIMESTAMP '{r.lower}' AND DATE_TIME <= TIMESTAMP '{r.upper}'"


def _share(t: int) -> str:
    return f"ROUND(SUM(CASE WHEN AVERAGE_SPEED <= {t} THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 1)"


def _kpis(where: str, t: int) -> str:
    return f"""
SELECT COUNT(*) AS total_rows,
       ROUND(AVG(AVERAGE_SPEED), 1) AS avg_speed,
       {_share(t)} AS stau_pct,
       ROUND(AVG(NUMBER_OF_VEHICLES), 1) AS avg_vehicles,
       CAST(SUM(NUMBER_OF_VEHICLES) AS BIGINT) AS total_vehicles
FROM traffic WHERE {where}"""


def _weekday_hour(where: str, t: int) -> str:
    return f"""
SELECT dow, hour, {_share(t)} AS stau_pct
FROM traffic WHERE {where}
GROUP BY dow, hour ORDER BY dow, hour"""


def _histogram(where: str) -> str:
    return f"""
SELECT FLOOR(AVERAGE_SPEED / 10) * 10 AS speed_bin, COUNT(*) AS cnt
FROM traffic WHERE {where}
GROUP BY speed_bin ORDER BY speed_bin"""


def _segments(where: str, t: int, min_rows: int, limit: int) -> str:
    return f"""
SELECT GEOHASH,
       ROUND(AVG(LATITUDE), 5) AS lat,
       ROUND(AVG(LONGITUDE), 5) AS lon,
       COUNT(*) AS messungen,
       ROUND(AVG(AVERAGE_SPEED), 1) AS avg_speed,
       {_share(t)} AS stau_pct
FROM traffic WHERE {where}
GROUP BY GEOHASH HAVING COUNT(*) > {min_rows}
ORDER BY stau_pct DESC, GEOHASH ASC LIMIT {limit}"""


def _matrix(where: str, t: int) -> str:
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(WEEKDAY_NAMES))
    hours = ",\n       ".join(
        f'COALESCE(MAX(CASE WHEN hour = {h} THEN stau_pct END), 0.0) AS "{h}"' for h in range(24)
    )
    return f"""
SELECT CASE dow {names} END AS weekday,
       {hours}
FROM ({_weekday_hour(where, t)}) cells
GROUP BY dow ORDER BY dow"""


def _hotspot_table(where: str, t: int) -> str:
    cols = ", ".join(f'{src} AS "{dst}"' for src, dst in HOTSPOT_DISPLAY_NAMES.items())
    return f"SELECT {cols} FROM ({_segments(where, t, 100, 50)}) top ORDER BY stau_pct DESC, GEOHASH"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express (all of the dashboard's)."""
    return dashboard_oracle() | _llm()[1]


def dashboard_oracle() -> dict[str, str]:
    """For each key in ``dashboard_queries()``, the same question in DuckDB SQL."""
    from roadpulse.plans import scenarios

    rng, empty, t = _range(RANGE), _range(EMPTY_RANGE), THRESHOLD
    sql = {
        "date_bounds": "SELECT CAST(MIN(DATE_TIME) AS DATE) AS d_min, CAST(MAX(DATE_TIME) AS DATE) AS d_max FROM traffic",
        "date_bounds_display": """
SELECT strftime(MIN(DATE_TIME), '%Y-%m-%d') AS d_min_text,
       strftime(MAX(DATE_TIME), '%Y-%m-%d') AS d_max_text,
       strftime(MIN(DATE_TIME), '%b %Y') || ' – ' || strftime(MAX(DATE_TIME), '%b %Y') AS period
FROM traffic""",
        "derive_calendar": "SELECT * FROM traffic",
        "range_filter": f"SELECT * FROM traffic WHERE {rng}",
        "kpis": _kpis(rng, t),
        "kpis_empty_range": _kpis(empty, t),
        "kpis_full_threshold_40": _kpis(FULL, 40),
        "monthly_trend": f"""
SELECT month_ts,
       ROUND(AVG(AVERAGE_SPEED), 1) AS avg_speed,
       {_share(t)} AS stau_pct,
       CAST(SUM(NUMBER_OF_VEHICLES) AS BIGINT) AS total_vehicles
FROM traffic WHERE {rng}
GROUP BY month_ts ORDER BY month_ts""",
        "weekday_hour": _weekday_hour(rng, t),
        "weekday_hour_matrix": _matrix(rng, t),
        "hour_of_day": f"""
SELECT hour, ROUND(AVG(AVERAGE_SPEED), 1) AS avg_speed, {_share(t)} AS stau_pct
FROM traffic WHERE {rng}
GROUP BY hour ORDER BY hour""",
        "speed_histogram": _histogram(FULL),
        "speed_histogram_labeled": f"""
SELECT speed_bin, cnt,
       CAST(CAST(speed_bin AS INT) AS VARCHAR) || '–' || CAST(CAST(speed_bin AS INT) + 9 AS VARCHAR) AS label,
       COALESCE(speed_bin <= {t}, false) AS congested,
       CASE WHEN speed_bin <= {t} THEN '#e53935' ELSE '#42a5f5' END AS color
FROM ({_histogram(FULL)}) h ORDER BY speed_bin""",
        "hotspots": _segments(FULL, t, 100, 50),
        "hotspots_threshold_45": _segments(FULL, 45, 100, 50),
        "hotspot_table": _hotspot_table(FULL, t),
        "map_points": f"SELECT lat, lon, stau_pct, avg_speed, messungen FROM ({_segments(FULL, t, 50, 500)}) s",
        "map_points_range": f"SELECT lat, lon, stau_pct, avg_speed, messungen FROM ({_segments(rng, t, 50, 500)}) s",
        "monthly_vehicles": f"""
SELECT month_ts,
       ROUND(AVG(NUMBER_OF_VEHICLES), 2) AS avg_vehicles,
       CAST(SUM(NUMBER_OF_VEHICLES) AS BIGINT) AS total_vehicles
FROM traffic WHERE {rng}
GROUP BY month_ts ORDER BY month_ts""",
        "kpi_display": f"""
SELECT format('{{:,}}', total_rows) AS total_rows_text,
       CAST(avg_speed AS VARCHAR) || ' km/h' AS avg_speed_text,
       CAST(stau_pct AS VARCHAR) || ' %' AS stau_pct_text,
       CAST(avg_vehicles AS VARCHAR) AS avg_vehicles_text
FROM ({_kpis(rng, t)}) k""",
    }
    sql.update(scenarios.oracle())
    # The order of a report as a column.
    full = {
        "monthly_trend": sql["monthly_trend"].replace(rng, FULL),
        "weekday_hour": _weekday_hour(FULL, t),
        "hour_of_day": sql["hour_of_day"].replace(rng, FULL),
        "speed_histogram": _histogram(FULL),
        "monthly_vehicles": sql["monthly_vehicles"].replace(rng, FULL),
        "hotspots": _segments(FULL, t, 100, 50),
        "map_points": _segments(FULL, t, 50, 500),
    }
    for name, order in scenarios.ORDERS.items():
        columns = "lat, lon, stau_pct, avg_speed, messungen" if name == "map_points" else "*"
        sql[f"ordered_{name}"] = f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM ({full[name]}) r"
    # What a picked date stands for: that day, or (in a sequence) all days from it on.
    middle = "(SELECT MIN(DATE_TIME)::DATE + ((MAX(DATE_TIME)::DATE - MIN(DATE_TIME)::DATE) // 2)::INT FROM traffic)"
    sql["kpis_one_day"] = _kpis(f"DATE_TIME::DATE = {middle}", t)
    sql["kpis_from_a_day"] = _kpis(f"DATE_TIME::DATE >= {middle}", t)
    # The views open on all rows that stay after the removal.
    kept = f"year(DATE_TIME) <> {scenarios.REMOVED_YEAR}"
    sql["view_kpis_after_removal"] = _kpis(kept, scenarios.VIEW_THRESHOLD)
    sql["view_hotspots_after_removal"] = _segments(kept, scenarios.VIEW_THRESHOLD, 100, 50)
    sql["view_map_points_after_removal"] = (
        f"SELECT lat, lon, stau_pct, avg_speed, messungen FROM ({_segments(kept, scenarios.VIEW_THRESHOLD, 50, 500)}) s"
    )
    # Rollup-backed figures must equal the direct reports exactly.
    for name in (
        "date_bounds",
        "kpis",
        "monthly_trend",
        "weekday_hour",
        "hour_of_day",
        "speed_histogram",
        "monthly_vehicles",
    ):
        sql[f"rollup_{name}"] = sql[name]
    sql["rollup_hotspots"] = sql["hotspots"]
    sql["rollup_hotspots_mid_range"] = _segments(_range(MID_RANGE), t, 100, 50)
    sql["rollup_map_points"] = sql["map_points_range"]
    sql["rollup_map_points_mid_range"] = (
        f"SELECT lat, lon, stau_pct, avg_speed, messungen FROM ({_segments(_range(MID_RANGE_SHORT), t, 50, 500)}) s"
    )
    # Page figures must equal the direct reports over the same range.
    page_sql = {
        "kpis": sql["kpis"],
        "monthly_trend": sql["monthly_trend"],
        "weekday_hour": sql["weekday_hour"],
        "hour_of_day": sql["hour_of_day"],
        "speed_histogram": _histogram(rng),
        "monthly_vehicles": sql["monthly_vehicles"],
        "hotspots": sql["hotspots"],
        "map_points": sql["map_points_range"],
    }
    sql.update({f"page_{k}": v for k, v in page_sql.items()})
    return {k: TRAFFIC_CTE + v for k, v in sql.items()}
