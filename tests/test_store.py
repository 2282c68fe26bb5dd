"""The store's record keeping: one writer, small changes, folders of loads, the catalog
table, detected formats."""

import json
import os
import threading

import pytest
from fixtures import HEADER, month_rows, write_csv
from test_sync import assert_rollup_consistent, manifest_of, months_in

from roadpulse.plans.inspect import plan_text
from roadpulse.sources import manifest as manifest_module
from roadpulse.sources.manifest import GONE, LOADED, FileEntry, Manifest, StoreBusy
from roadpulse.sources.store import TrafficStore
from roadpulse.sources.sync import sync


@pytest.fixture()
def place(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    return src, TrafficStore(spark, str(tmp_path / "store"))


# -- one writer --------------------------------------------------------------------
class Between(TrafficStore):
    """Calls ``then`` after each of its writes."""

    then = None

    def _done(self, step):
        if self.then:
            self.then(step)


def test_second_sync_between_two_writes_raises(spark, place):
    src, st = place
    write_csv(src / "a_202401.csv", month_rows(2024, 1, 3))
    write_csv(src / "b_202402.csv", month_rows(2024, 2, 4))
    raised = []

    def second(step):
        with pytest.raises(StoreBusy):
            sync(spark, str(src), TrafficStore(spark, st.root))
        raised.append(step)

    first = Between(spark, st.root)
    first.then = second
    assert sync(spark, str(src), first).loaded == ["a_202401.csv", "b_202402.csv"]
    assert len(raised) >= 4
    assert months_in(st) == [(2024, 1, 3), (2024, 2, 4)]
    assert manifest_of(st) == ["a_202401.csv", "b_202402.csv"]
    assert_rollup_consistent(st)
    assert sync(spark, str(src), st).loaded == []  # the store is free again


@pytest.mark.parametrize("at", ["recorded", "rows", "rollup"])
def test_run_that_was_taken_over_publishes_nothing(spark, place, at):
    """The first run is taken for lost; it wakes up after the second is done."""
    src, st = place
    write_csv(src / "a_202401.csv", month_rows(2024, 1, 3))

    def second(step):
        if step == at:
            first.then = None
            assert sync(spark, str(src), TrafficStore(spark, st.root), take_over=True).repaired == ["a_202401.csv"]

    first = Between(spark, st.root)
    first.then = second
    with pytest.raises(StoreBusy):
        sync(spark, str(src), first)
    assert months_in(st) == [(2024, 1, 3)]
    assert manifest_of(st) == ["a_202401.csv"]
    assert_rollup_consistent(st)


def test_lost_run_can_be_taken_over_when_old(spark, place, monkeypatch):
    src, st = place
    write_csv(src / "a_202401.csv", month_rows(2024, 1, 3))
    st.ensure()
    with open(os.path.join(st.log.path, "writer.json"), "w") as f:
        f.write("a run on a machine that is gone")
    with pytest.raises(StoreBusy, match="take_over"):
        sync(spark, str(src), st)
    monkeypatch.setattr(manifest_module, "LEASE_S", 0.0)
    monkeypatch.setattr(Manifest, "_beat", lambda self, done: done.wait())
    assert sync(spark, str(src), st).loaded == ["a_202401.csv"]


def test_holding_is_kept_fresh(spark, place, monkeypatch):
    _, st = place
    st.ensure()
    monkeypatch.setattr(manifest_module, "LEASE_S", 0.4)
    with st.writing():
        lock = os.path.join(st.log.path, "writer.json")
        os.utime(lock, (0, 0))
        for _ in range(100):
            if os.stat(lock).st_mtime > 0:
                break
            threading.Event().wait(0.05)
        assert os.stat(lock).st_mtime > 0
    assert not os.path.exists(lock)


def test_change_needs_the_store(spark, place):
    _, st = place
    st.ensure()
    with pytest.raises(StoreBusy):
        st.log.change([FileEntry("a", LOADED, "1.a")], under_way=False)


# -- the manifest --------------------------------------------------------------------
def entries(log):
    return sorted(tuple(r) for r in log.table().collect())


def test_changes_are_small_and_compacted(spark, place, monkeypatch):
    _, st = place
    st.ensure()
    log = st.log
    monkeypatch.setattr(manifest_module, "KEPT_CHANGES", 3)
    with log.writing():
        log.change([FileEntry(f"f{i}", LOADED, f"1.{i}") for i in range(5000)], under_way=False)
        for k in range(4):
            log.change([FileEntry(f"f{k}", GONE), FileEntry(f"n{k}", LOADED, f"2.{k}")], under_way=False)
        names = [n for n in os.listdir(log.path) if not n.startswith(".") and not n.startswith("writer")]
        assert sorted(n[:2] for n in names) == ["d-", "s-"]
        size = max(os.path.getsize(os.path.join(log.path, n)) for n in names if n.startswith("d-"))
        assert size < 400  # of 5,000 entries
    want = [(f"f{i}", LOADED, f"1.{i}") for i in range(4, 5000)] + [(f"n{k}", LOADED, f"2.{k}") for k in range(4)]
    assert entries(log) == sorted(want)
    assert entries(Manifest(spark, log.path)) == sorted(want)


def test_half_written_change_and_snapshot_are_passed_over(spark, place):
    _, st = place
    st.ensure()
    log = st.log
    with log.writing():
        log.change([FileEntry("a", LOADED, "1.a")], under_way=False)
    with open(os.path.join(log.path, "d-000000000002.json"), "w") as f:
        f.write(json.dumps({"filename": "b", "state": LOADED, "load": "2.b", "version": 2}) + "\n")
    os.makedirs(os.path.join(log.path, "s-000000000002"))
    assert entries(log) == [("a", LOADED, "1.a")]
    with log.writing():
        log.change([FileEntry("c", LOADED, "3.c")], under_way=False)
    assert entries(log) == [("a", LOADED, "1.a"), ("c", LOADED, "3.c")]
    assert os.path.exists(os.path.join(log.path, "d-000000000003.json"))


def test_no_list_of_names_in_the_plans(spark, place):
    src, st = place
    for m in (1, 2, 3):
        write_csv(src / f"marked_2024{m:02d}.csv", month_rows(2024, m, 2))
    sync(spark, str(src), st)
    for df in (st.manifest(), st.table(), st.rollup()):
        assert "marked_" not in plan_text(df)


# -- folders of loads ------------------------------------------------------------------
def test_removing_one_file_touches_no_other_rows(spark, place):
    src, st = place
    for k in range(6):
        write_csv(src / f"f{k}_202401.csv", month_rows(2024, 1, 3, geohash=f"g{k}"))
    sync(spark, str(src), st)

    def listed():
        return {
            os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for path in st._paths
            for d, _, fs in os.walk(path)
            for f in fs
            if f.endswith(".parquet")
        }

    before = listed()
    os.remove(src / "f2_202401.csv")
    spark.sparkContext.setJobGroup("removal", "removal")
    called = []
    st.stored = lambda rng=None: called.append(1)
    try:
        assert sync(spark, str(src), st, match="file").dropped_months == [(2024, 1)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        del st.stored
    after = listed()
    assert called == [] and after.items() <= before.items()
    assert len(before) - len(after) == 3  # its rows and its part of both rollups
    assert {r["GEOHASH"] for r in st.table().collect()} == {f"g{k}" for k in range(6) if k != 2}
    assert_rollup_consistent(st)


def test_rows_under_way_are_not_read(spark, place):
    src, st = place
    write_csv(src / "a_202401.csv", month_rows(2024, 1, 3))
    sync(spark, str(src), st)
    write_csv(src / "b_202401.csv", month_rows(2024, 1, 4, geohash="b"))
    seen = []

    def look(step):
        reader = TrafficStore(spark, st.root)
        seen.append((step, reader.table().count(), reader.rollup().agg({"n": "sum"}).first()[0]))

    writer = Between(spark, st.root)
    writer.then = look
    sync(spark, str(src), writer)
    assert [s[1:] for s in seen if s[0] != "loaded"] == [(3, 3)] * (len(seen) - 1)
    assert seen[-1] == ("loaded", 7, 7)


def test_bounds_pass_over_months_without_rows(spark, place):
    """Removed files leave empty month folders, a load under way has rows not to count."""
    src, st = place
    for m in (1, 2, 3, 4):
        write_csv(src / f"f_2024{m:02d}.csv", month_rows(2024, m, 3))
    sync(spark, str(src), st)
    os.remove(src / "f_202401.csv")
    os.remove(src / "f_202404.csv")
    sync(spark, str(src), st, match="file")
    want = [tuple(map(str, ("2024-02-01", "2024-03-03")))]
    assert [tuple(map(str, r)) for r in st.date_bounds().collect()] == want
    write_csv(src / "e_202312.csv", month_rows(2023, 12, 3))
    seen = []
    writer = Between(spark, st.root)
    writer.then = lambda step: seen.append([tuple(map(str, r)) for r in TrafficStore(spark, st.root).date_bounds().collect()])
    sync(spark, str(src), writer)
    assert seen[:-1] == [want] * (len(seen) - 1)
    assert seen[-1] == [("2023-12-01", "2024-03-03")]
    view = st.view(None, 20)
    assert view.kpis().first()["total_rows"] == 9
    view.close()


# -- the catalog table -----------------------------------------------------------------
def test_catalog_table(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    name = "traffic_of_test"
    st = TrafficStore(spark, str(tmp_path / "store"), table_name=name)
    rows = month_rows(2024, 1, 4)
    rows[1]["DATE_TIME"] = None
    write_csv(src / "a_202401.csv", rows)
    write_csv(src / "b_202402.csv", month_rows(2024, 2, 5))
    try:
        sync(spark, str(src), st)

        def counts():
            got = spark.sql(f"SELECT year, month, count(*) AS n FROM {name} GROUP BY ALL").collect()
            return sorted((tuple(r) for r in got), key=str)

        assert counts() == [(2024, 1, 3), (2024, 2, 5), (None, None, 1)]
        february = spark.sql(f"SELECT GEOHASH FROM {name} WHERE year = 2024 AND month = 2")
        assert february.count() == 5 and len(february.inputFiles()) == 1
        write_csv(src / "c_202402.csv", month_rows(2024, 2, 2, geohash="c"))
        sync(spark, str(src), st)
        os.remove(src / "a_202401.csv")
        sync(spark, str(src), st, match="file")
        assert counts() == [(2024, 2, 7)]
        os.remove(src / "b_202402.csv")
        sync(spark, str(src), st)
        assert counts() == [] and spark.sql(f"SHOW PARTITIONS {name}").count() == 0
        # Another session's catalog: made from what the manifest has as loaded.
        write_csv(src / "d_202403.csv", month_rows(2024, 3, 6))
        sync(spark, str(src), st)
        spark.sql(f"DROP TABLE {name}")
        sync(spark, str(src), TrafficStore(spark, st.root, table_name=name))
        assert counts() == [(2024, 3, 6)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# -- detected formats ----------------------------------------------------------------
def written(src, name, rows, dates, decimal=".", delimiter=",", quote=""):
    with open(src / name, "w") as f:
        q = (lambda v: f"{quote}{v}{quote}") if quote else str
        f.write(delimiter.join(q(h) for h in HEADER) + "\n")
        for r in rows:
            made = dict(r, DATE_TIME=dates(r["DATE_TIME"]))
            f.write(delimiter.join(q(str(made[h]).replace(".", decimal) if h in ("LATITUDE", "LONGITUDE", "AVERAGE_SPEED") else made[h]) for h in HEADER) + "\n")


def parts(iso):
    day, time = iso.split(" ")
    return *day.split("-"), time


FORMATS = {
    "iso": lambda v: v,
    "t": lambda v: v.replace(" ", "T"),
    "minutes": lambda v: v[:-3],
    "points": lambda v: "{2}.{1}.{0} {3}".format(*parts(v)),
    "points and minutes": lambda v: "{2}.{1}.{0} {3}".format(*parts(v))[:-3],
    "year first": lambda v: "{0}/{1}/{2} {3}".format(*parts(v)),
    "day first": lambda v: "{2}/{1}/{0} {3}".format(*parts(v)),
    "month first": lambda v: "{1}/{2}/{0} {3}".format(*parts(v)),
    "dashes": lambda v: "{2}-{1}-{0} {3}".format(*parts(v)),
    "am pm": lambda v: "{1}/{2}/{0} ".format(*parts(v)) + twelve(parts(v)[3]),
}


def twelve(time):
    h = int(time[:2])
    return f"{(h + 11) % 12 + 1:02d}{time[2:]} {'AM' if h < 12 else 'PM'}"


def test_formats_of_one_folder_give_equal_rows(spark, place):
    src, st = place
    rows = month_rows(2024, 1, 28)
    rows[3]["AVERAGE_SPEED"] = 30.6
    for k, (name, dates) in enumerate(FORMATS.items()):
        mark = {1: ",", 0: "."}[k % 2]
        written(src, f"{name}.csv", rows, dates, decimal=mark, delimiter=";" if k % 2 else ",", quote=["", '"', "'"][k % 3])
    sync(spark, str(src), st)
    got = {}
    for r in st.stored().collect():
        got.setdefault(r["source_file"], []).append((str(r["DATE_TIME"]), r["LATITUDE"], r["LONGITUDE"], r["AVERAGE_SPEED"], r["hour"]))
    assert sorted(got) == sorted(f"{n}.csv" for n in FORMATS)
    want = sorted(got["iso.csv"])
    assert len(want) == 28
    for name, have in got.items():
        assert sorted(have) == want, name


def test_order_seen_late_in_the_file(spark, place):
    """The first lines fit day and month first; the last line tells."""
    src, st = place
    rows = [dict(month_rows(2024, 3, 1)[0], DATE_TIME=f"2024-03-04 {h % 24:02d}:00:00") for h in range(300)]
    rows.append(dict(rows[0], DATE_TIME="2024-03-25 00:00:00"))
    written(src, "a.csv", rows, FORMATS["month first"])
    written(src, "b.csv", rows, FORMATS["day first"])
    # All values fit both: the day comes first, but not before an AM/PM time.
    written(src, "c.csv", rows[:50], FORMATS["day first"])
    written(src, "d.csv", rows[:50], FORMATS["am pm"])
    sync(spark, str(src), st)
    found = {(r["source_file"], r["year"], r["month"]) for r in st.stored().collect()}
    assert found == {(f"{n}.csv", 2024, 3) for n in "abcd"}


def test_several_formats_in_one_file_are_an_error(spark, place):
    src, st = place
    rows = month_rows(2024, 1, 4)
    written(src, "a.csv", rows, lambda v: FORMATS["points"](v) if v.startswith("2024-01-02") else v)
    with pytest.raises(ValueError, match="several formats"):
        sync(spark, str(src), st)
    assert st.table().count() == 0


def test_no_dates_at_all(spark, place):
    src, st = place
    write_csv(src / "a.csv", [dict(r, DATE_TIME=None) for r in month_rows(2024, 1, 3)])
    write_csv(src / "b.csv", [])
    sync(spark, str(src), st)
    assert st.table().count() == 3 and manifest_of(st) == ["a.csv", "b.csv"]
