"""Plan shapes and the shared-scan page against the direct reports."""

import pytest
from fixtures import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadpulse.operators import reports
from roadpulse.operators.filters import DateRange
from roadpulse.plans.dashboard import Page
from roadpulse.plans.inspect import count_exchanges, plan_text, uses_python
from roadpulse.sources.fixture import traffic_fixture
from roadpulse.schema import STORED_SCHEMA
from roadpulse.sources.store import TrafficStore

RNG = DateRange.of("1997-01-01", "1999-12-31")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    st = TrafficStore(spark, str(tmp_path_factory.mktemp("store"))).ensure()
    st.load_rows(traffic_fixture(spark, SF_SMALL).withColumn("source_file", F.lit("fixture.csv")), ["fixture.csv"])
    return st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_range_reaches_partition_and_parquet_filters(store):
    text = plan_text(reports.kpis(store.table(), RNG, 20))
    assert "PartitionFilters: [" in text and "year" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "DATE_TIME" in pushed
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "GEOHASH" not in schema and "LATITUDE" not in schema and "AVERAGE_SPEED" in schema


def test_partition_bound_only_on_partition_columns(spark, store):
    from roadpulse.schema import is_partitioned

    assert is_partitioned(store.table().schema)
    fx = traffic_fixture(spark, SF_SMALL)
    assert not is_partitioned(fx.schema)
    # On the fixture year/month are derived per row: the range stays a pure
    # timestamp predicate, with no per-row year/month bound.
    text = plan_text(reports.kpis(fx, RNG, 20), "simple")
    assert "199701" not in text and "199912" not in text
    assert "199701" in plan_text(reports.kpis(store.table(), RNG, 20), "simple")


def test_hotspots_plan_is_top_k_with_one_shuffle(store):
    df = reports.hotspots(store.table(), RNG, 20)
    text = plan_text(df, "simple")
    assert "TakeOrderedAndProject" in text and "PartialAggregate" not in text
    assert "HashAggregate" in text and count_exchanges(df) == 1


def test_no_python_and_no_cross_join_in_any_registered_query(spark):
    """The scenarios that load a store end in reads of it, which the other tests
    here cover."""
    from roadpulse.plans.scenarios import loads

    for name, fn in entry.dashboard_queries().items():
        if name in loads():
            continue
        df = fn(spark, SF_SMALL)
        text = plan_text(df, "simple")
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
        assert not uses_python(df), name


def test_store_reports_equal_fixture_reports(spark, store):
    fx = traffic_fixture(spark, SF_SMALL)
    for f in (reports.monthly_trend, reports.weekday_hour, reports.hotspots):
        assert rows(f(store.table(), RNG, 20)) == rows(f(fx, RNG, 20))


@pytest.mark.parametrize("use_rollup", [False, True])
@pytest.mark.parametrize(
    "rng,thr",
    [(RNG, 20), (None, 35), (DateRange.of("1980-01-01", "1980-02-01"), 20), (DateRange.of("1996-03-05", "1996-03-05"), 40)],
)
def test_page_equals_direct_reports(spark, store, rng, thr, use_rollup):
    t = store.table()
    page = Page(t, rng, thr, rollup=store.rollup() if use_rollup else None)
    try:
        direct = {
            "kpis": reports.kpis(t, rng, thr),
            "monthly_trend": reports.monthly_trend(t, rng, thr),
            "weekday_hour": reports.weekday_hour(t, rng, thr),
            "hour_of_day": reports.hour_of_day(t, rng, thr),
            "speed_histogram": reports.speed_histogram(t, rng),
            "hotspots": reports.hotspots(t, rng, thr),
            "map_points": reports.map_points(t, rng, thr),
            "monthly_vehicles": reports.monthly_vehicles(t, rng),
        }
        for name, df in page.figures().items():
            assert df.collect() == direct[name].collect(), name
        fetched = page.fetch()
        assert sorted(fetched) == sorted(direct)
        want = direct["kpis"].first()
        got = next(fetched["kpis"].itertuples(index=False))
        assert [None if v is None or v != v else v for v in got] == list(want)
        p2 = page.with_threshold(45)
        assert p2.weekday_hour().collect() == reports.weekday_hour(t, rng, 45).collect()
    finally:
        page.close()


def test_store_date_bounds_reads_two_months(spark, store):
    assert store.date_bounds().collect() == reports.date_bounds(store.table()).collect()
    months = sorted((r["year"], r["month"]) for r in store.table().select("year", "month").distinct().collect())
    read = {f.split("/traffic/")[1].split("/load=")[0] for f in store._first_and_last(store.table_path, STORED_SCHEMA).inputFiles()}
    assert read == {f"year={y}/month={m}" for y, m in (months[0], months[-1])}


def test_store_date_bounds_empty(spark, tmp_path):
    st = TrafficStore(spark, str(tmp_path / "empty")).ensure()
    assert tuple(st.date_bounds().first()) == (None, None)


def test_open_view_flow(spark, store):
    import datetime as dt

    from roadpulse.plans.dashboard import data_bounds, open_view

    t = store.table()
    lo, hi = data_bounds(t)
    page = open_view(t, (dt.date(1997, 1, 1),), 20)
    try:
        assert page.rng == DateRange(dt.date(1997, 1, 1), hi)
        assert page.kpis().collect() == reports.kpis(t, page.rng, 20).collect()
    finally:
        page.close()
    view = store.view((dt.date(1997, 1, 1), dt.date(1998, 6, 30)), 35)
    try:
        rng = DateRange.of("1997-01-01", "1998-06-30")
        assert view.monthly_trend().collect() == reports.monthly_trend(t, rng, 35).collect()
        assert view.hotspots().collect() == reports.hotspots(t, rng, 35).collect()
    finally:
        view.close()
    with pytest.raises(ValueError):
        open_view(t, None, 22)
    with pytest.raises(ValueError):
        open_view(t, (lo - dt.timedelta(days=1), hi), 20)


def test_rollup_bounds_and_last_second(spark, tmp_path):
    import datetime as dt

    from roadpulse.functions.calendar import with_calendar
    from roadpulse.plans.rollup import bounds_from_rollup, build_rollup
    from roadpulse.schema import RAW_SCHEMA

    rows = [
        (dt.datetime(2024, 1, 31, 23, 59, 59), 41.0, 29.0, "a", 0, 9, 10, 1),
        (dt.datetime(2024, 1, 31, 23, 59, 59, 500000), 41.0, 29.0, "a", 0, 9, 30, 1),
        (dt.datetime(2024, 1, 1, 0, 0, 0), 41.0, 29.0, "a", 0, 9, 50, 1),
        (None, 41.0, 29.0, "a", 0, 9, 70, 1),
    ]
    t = with_calendar(spark.createDataFrame(rows, RAW_SCHEMA))
    ru = build_rollup(t)
    for rng in (DateRange.of("2024-01-01", "2024-01-31"), DateRange.of("2024-01-31", "2024-02-01"), None):
        page = Page(t, rng, 20, persist=False, rollup=ru)
        assert page.kpis().collect() == reports.kpis(t, rng, 20).collect()
        assert page.speed_histogram().collect() == reports.speed_histogram(t, rng).collect()
    assert bounds_from_rollup(ru).collect() == reports.date_bounds(t).collect()


def test_fetch_brings_every_figure_through_arrow(spark, store):
    import pandas as pd

    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        return v.to_pydatetime() if hasattr(v, "to_pydatetime") else v

    page = Page(store.table(), RNG, 20)
    try:
        fetched = page.fetch()
        for name, df in page.figures().items():
            want = [tuple(r) for r in df.collect()]
            got = [tuple(plain(v) for v in rec) for rec in fetched[name].itertuples(index=False)]
            assert got == want, name
    finally:
        page.close()


@pytest.mark.parametrize(
    "rng,thr",
    [
        (None, 20),
        (RNG, 45),
        (DateRange.of("1995-03-15", "2001-10-20"), 20),
        (DateRange.of("1996-02-01", "1996-02-29"), 60),
        (DateRange.of("1996-02-01", "1996-03-01"), 5),
        (DateRange.of("1996-01-31", "1996-02-01"), 20),
        (DateRange.of("1980-01-01", "1980-02-01"), 20),
        (DateRange.of("1995-03-15", "2001-10-20"), 33),
    ],
)
def test_segment_rollup_page_equals_direct_reports(spark, store, rng, thr):
    """Hotspots and map from the segment rollup (whole months) plus the edge
    months' rows equal the direct reports; a threshold outside the domain
    (33) falls back to the measurements."""
    t = store.table()
    page = Page(t, rng, thr, persist=False, segment_rollup=store.segment_rollup())
    assert page.hotspots().collect() == reports.hotspots(t, rng, thr).collect()
    assert page.map_points().collect() == reports.map_points(t, rng, thr).collect()
    # Every segment's figures, not only the top of the list.
    assert rows(page._segments) == rows(reports.segment_stats(t, rng, thr))


def test_segment_rollup_last_second_of_month(spark):
    import datetime as dt

    from roadpulse.functions.calendar import with_calendar
    from roadpulse.plans.segment_rollup import build_segment_rollup
    from roadpulse.schema import RAW_SCHEMA

    rows_in = [
        (dt.datetime(2024, 1, 31, 23, 59, 59), 41.0, 29.0, "a", 0, 9, 10, 1),
        (dt.datetime(2024, 1, 31, 23, 59, 59, 500000), 41.0, 29.0, "a", 0, 9, 30, 1),
        (dt.datetime(2024, 1, 1, 0, 0, 0), 41.0, 29.0, "a", 0, 9, 50, 1),
        (dt.datetime(2024, 2, 10, 5, 0, 0), 41.5, 29.5, "b", 0, 9, None, 1),
        (None, 41.0, 29.0, "a", 0, 9, 70, 1),
    ]
    t = with_calendar(spark.createDataFrame(rows_in, RAW_SCHEMA))
    sr = build_segment_rollup(t)
    for rng in (
        DateRange.of("2024-01-01", "2024-01-31"),
        DateRange.of("2024-01-01", "2024-02-29"),
        DateRange.of("2024-01-31", "2024-02-01"),
        None,
    ):
        page = Page(t, rng, 20, persist=False, segment_rollup=sr)
        assert rows(page._segments) == rows(reports.segment_stats(t, rng, 20)), rng


@pytest.mark.parametrize(
    "rng",
    [
        RNG,
        DateRange.of("1995-03-15", "1995-04-02"),
        DateRange.of("1999-12-01", "2000-01-31"),
        DateRange.of("1980-01-01", "1980-03-01"),
    ],
)
def test_range_scoped_reads_equal_full_reads(spark, store, rng):
    """Reading only the month folders a range touches gives the same figures
    as reading the whole store, and lists no month outside the range."""
    full = store.table()
    scoped = store.table(rng)
    lo, hi = rng.start.year * 100 + rng.start.month, rng.end.year * 100 + rng.end.month
    months = {r["year"] * 100 + r["month"] for r in scoped.select("year", "month").distinct().collect()}
    assert all(lo <= ym <= hi for ym in months)
    for f in (reports.kpis, reports.monthly_trend, reports.hotspots):
        assert f(scoped, rng, 20).collect() == f(full, rng, 20).collect(), f.__name__
    page = Page(scoped, rng, 20, persist=False, rollup=store.rollup(rng), segment_rollup=store.segment_rollup(rng))
    assert page.kpis().collect() == reports.kpis(full, rng, 20).collect()
    assert page.hotspots().collect() == reports.hotspots(full, rng, 20).collect()
    assert page.map_points().collect() == reports.map_points(full, rng, 20).collect()


def test_store_view_reads_only_range_months(spark, store):
    import datetime as dt

    view = store.view((dt.date(1996, 2, 10), dt.date(1997, 3, 5)), 25)
    try:
        rng = DateRange.of("1996-02-10", "1997-03-05")
        months = {(r["year"], r["month"]) for r in view.traffic.select("year", "month").distinct().collect()}
        assert min(months) >= (1996, 2) and max(months) <= (1997, 3)
        t = store.table()
        for name, df in view.figures().items():
            direct = getattr(reports, name)
            args = (t, rng) if name in ("speed_histogram", "monthly_vehicles") else (t, rng, 25)
            assert df.collect() == direct(*args).collect(), name
    finally:
        view.close()


def scans_of(view, spark):
    text = plan_text(view._segments)
    return [line for line in text.splitlines() if line.startswith("Location") and "/traffic/" in line or "/traffic]" in line]


def test_default_view_reads_no_measurements(spark, store):
    """Nothing picked: the edge months' rows all lie inside the data's own
    bounds, so hotspots and map come from the segment rollup alone."""
    view = store.view(None, 20)
    try:
        assert not scans_of(view, spark)
        t = store.table()
        assert view.hotspots().collect() == reports.hotspots(t, view.rng, 20).collect()
        assert rows(view._segments) == rows(reports.segment_stats(t, view.rng, 20))
    finally:
        view.close()
    import datetime as dt

    part = store.view((dt.date(1996, 2, 10), dt.date(1997, 3, 5)), 20)
    try:
        assert scans_of(part, spark)
    finally:
        part.close()


def test_new_threshold_keeps_the_cells(spark, store):
    page = Page(store.table(), RNG, 20)
    other = page.with_threshold(45)
    other.close()
    assert page._cells.is_cached and page._segments.is_cached
    page.close()
    assert not page._cells.is_cached
    plain = Page(store.table(), RNG, 20, persist=False).with_threshold(45)
    assert not plain._segments.is_cached


def test_hot_month_of_segments_is_written_by_several_tasks(spark, tmp_path):
    """One month of many segments: several files, equal figures; a small month
    keeps one."""
    from roadpulse.functions.calendar import with_calendar

    n = 40000
    one = spark.range(n).select(
        F.expr("timestamp_ntz'2024-01-05 10:00:00'").alias("DATE_TIME"),
        F.lit(41.0).alias("LATITUDE"),
        F.lit(29.0).alias("LONGITUDE"),
        F.concat(F.lit("s"), F.col("id")).alias("GEOHASH"),
        *[F.lit(30).alias(c) for c in ("MINIMUM_SPEED", "MAXIMUM_SPEED", "AVERAGE_SPEED", "NUMBER_OF_VEHICLES")],
    )
    small = one.limit(5).withColumn("DATE_TIME", F.expr("timestamp_ntz'2024-02-05 10:00:00'"))
    loaded = with_calendar(one.unionByName(small)).withColumn("source_file", F.lit("a.csv"))
    st = TrafficStore(spark, str(tmp_path / "s")).ensure()
    # The aggregate's own partitions stay apart, as they would at size.
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        st.load_rows(loaded, ["a.csv"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")

    def parts(month):
        return list((tmp_path / "s" / "segment_rollup" / "year=2024" / f"month={month}").glob("load=*/*.parquet"))

    assert len(parts(1)) > 1 and len(parts(2)) == 1
    assert st.segment_rollup().where("month = 1").count() == n
