"""Hand-made rows for the edge cases of FIXTURES.md section 5."""

import datetime as dt

import pytest

from roadpulse.functions.calendar import with_calendar
from roadpulse.functions.numeric import round_half_away
from roadpulse.operators import present, reports
from roadpulse.operators.filters import DateRange, check_range, check_threshold, normalize_range
from roadpulse.schema import RAW_SCHEMA
from roadpulse.sources.sync import months_of


def frame(spark, rows):
    """rows: (timestamp, geohash, speed, vehicles)."""
    data = [(ts, 41.0, 29.0, g, 0, 100, s, v) for ts, g, s, v in rows]
    return with_calendar(spark.createDataFrame(data, RAW_SCHEMA))


T0 = dt.datetime(2024, 1, 10, 8, 0, 0)


def test_null_speed_counts_in_denominator(spark):
    df = frame(spark, [(T0, "a", None, 1), (T0, "a", 20, 2), (T0, "a", 21, 3)])
    r = reports.kpis(df, None, 20).first()
    assert r["total_rows"] == 3 and r["stau_pct"] == 33.3 and r["avg_speed"] == 20.5
    assert r["total_vehicles"] == 6 and r["avg_vehicles"] == 2.0


def test_threshold_is_inclusive(spark):
    df = frame(spark, [(T0, "a", 20, 1)])
    assert reports.kpis(df, None, 20).first()["stau_pct"] == 100.0
    assert reports.kpis(df, None, 15).first()["stau_pct"] == 0.0


def test_group_filters(spark):
    rows = []
    for g, n in [("s50", 50), ("s51", 51), ("s100", 100), ("s101", 101)]:
        rows += [(T0, g, 10, 1)] * n
    df = frame(spark, rows)
    assert sorted(r["messungen"] for r in reports.map_points(df, None, 20).collect()) == [51, 100, 101]
    assert [r["GEOHASH"] for r in reports.hotspots(df, None, 20).collect()] == ["s101"]


def test_last_second_of_range(spark):
    a = dt.datetime(2024, 1, 31, 23, 59, 59)
    b = dt.datetime(2024, 1, 31, 23, 59, 59, 500000)
    df = frame(spark, [(a, "a", 10, 1), (b, "a", 10, 1)])
    rng = DateRange.of("2024-01-01", "2024-01-31")
    assert reports.kpis(df, rng, 20).first()["total_rows"] == 1


def test_empty_range(spark):
    df = frame(spark, [(T0, "a", 10, 1)])
    r = reports.kpis(df, DateRange.of("1980-01-01", "1980-01-02"), 20).first()
    assert tuple(r) == (0, None, None, None, None)
    assert reports.monthly_trend(df, DateRange.of("1980-01-01", "1980-01-02"), 20).count() == 0


def test_weekday_origin_is_sunday(spark):
    df = frame(spark, [(dt.datetime(2024, 1, 7, 3), "a", 1, 1), (dt.datetime(2024, 1, 13, 4), "a", 1, 1)])
    assert [(r["dow"], r["hour"]) for r in reports.weekday_hour(df, None, 20).collect()] == [(0, 3), (6, 4)]
    m = present.weekday_hour_matrix(df, None, 20).collect()
    assert [r["weekday"] for r in m] == ["Sonntag", "Samstag"]
    assert m[0]["3"] == 100.0 and m[0]["4"] == 0.0 and len(m[0]) == 25


def test_bins_and_null_bin_last(spark):
    df = frame(spark, [(T0, "a", s, 1) for s in (0, 9, 10, 19, None)])
    got = [(r["speed_bin"], r["cnt"]) for r in reports.speed_histogram(df, None).collect()]
    assert got == [(0.0, 2), (10.0, 2), (None, 1)]
    lab = present.speed_histogram_labeled(df, None, 20).collect()
    assert [r["label"] for r in lab] == ["0–9", "10–19", None]
    assert [r["color"] for r in lab] == ["#e53935", "#e53935", "#42a5f5"]


def test_bin_label_and_class_at_threshold(spark):
    df = frame(spark, [(T0, "a", 25, 1)])
    r = present.speed_histogram_labeled(df, None, 20).first()
    assert r["label"] == "20–29" and r["congested"] is True


def test_rounding_matches_binary_half_away(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (0.125,), (33.35,)], "x double")
    got = [r[0] for r in df.select(round_half_away("x", 2)).collect()]
    assert got == [1.0, 2.5, -2.5, 0.13, 33.35]
    got1 = [r[0] for r in df.select(round_half_away("x", 0)).collect()]
    assert got1 == [1.0, 3.0, -3.0, 0.0, 33.0]


def test_name_parsing(spark):
    df = spark.createDataFrame([("traffic_density_202401.csv",), ("misc.csv",)], "filename string")
    assert [tuple(r) for r in months_of(df).collect()] == [(2024, 1)]


def test_kpi_display_text(spark):
    df = frame(spark, [(T0, "a", 20, 3)] * 1234)
    r = present.kpi_display(df, None, 20).first()
    assert tuple(r) == ("1,234", "20.0 km/h", "100.0 %", "3.0")


def test_hotspot_table_names(spark):
    df = frame(spark, [(T0, "a", 20, 3)] * 101)
    assert present.hotspot_table(df, None, 20).columns == ["Geohash", "Ø km/h", "Stau %", "Messungen"]


def test_parameters():
    bounds = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert normalize_range((dt.date(2024, 2, 1), dt.date(2024, 3, 1)), bounds) == DateRange.of("2024-02-01", "2024-03-01")
    assert normalize_range((dt.date(2024, 2, 1),), bounds) == DateRange.of("2024-02-01", "2024-12-31")
    assert normalize_range(dt.date(2024, 2, 1), bounds) == DateRange.of("2024-02-01", "2024-02-01")
    assert check_threshold(20) == 20
    for bad in (0, 7, 65, 20.5):
        with pytest.raises(ValueError):
            check_threshold(bad)
    with pytest.raises(ValueError):
        check_range(DateRange.of("2023-12-01", "2024-01-05"), bounds)


def test_date_bounds_empty_table(spark):
    df = frame(spark, [])
    assert tuple(reports.date_bounds(df).first()) == (None, None)


def test_partition_bound_is_implied(spark):
    df = frame(spark, [(dt.datetime(2023, 12, 31, 23), "a", 1, 1), (dt.datetime(2024, 1, 1, 0), "a", 1, 1),
                       (dt.datetime(2025, 1, 1, 0), "a", 1, 1)])
    rng = DateRange.of("2024-01-01", "2024-12-31")
    with_bound = df.where(rng.predicate()).count()
    without = df.where(rng.predicate(partition_bound=False)).count()
    assert with_bound == without == 1
