"""A run stopped after any of its writes, then a clean run: table, rollups and the
view are what an undisturbed run leaves."""

import os
import shutil

import pytest
from fixtures import month_rows, write_csv
from test_sync import assert_rollup_consistent, manifest_of

from roadpulse.sources.csv_source import list_csv_files
from roadpulse.sources.store import TrafficStore
from roadpulse.sources.sync import sync


class Stopped(Exception):
    pass


class Stopping(TrafficStore):
    """Raises after the ``stop``-th write of its steps."""

    stop = None
    writes = 0

    def _done(self, step):
        self.writes += 1
        if self.writes == self.stop:
            raise Stopped(step)


def folder(tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    write_csv(src / "a_202401.csv", month_rows(2024, 1, 5, geohash="a") + month_rows(2024, 2, 3, geohash="a"))
    write_csv(src / "b_202401.csv", month_rows(2024, 1, 4, geohash="b"))
    write_csv(src / "c_202403.csv", month_rows(2024, 3, 2, geohash="c") + [dict(month_rows(2024, 3, 1)[0], DATE_TIME=None)])
    return src


def assert_whole(st, months, names):
    assert months_in_all(st) == months
    assert manifest_of(st) == names
    assert_rollup_consistent(st)
    if any(y for y, _, _ in months):
        view = st.view(None, 20)
        try:
            assert view.kpis().first()["total_rows"] == sum(n for y, _, n in months if y)
        finally:
            view.close()


def months_in_all(st):
    from pyspark.sql import functions as F

    got = st.table().groupBy("year", "month").agg(F.count("*").alias("n")).collect()
    return sorted(((r["year"], r["month"], r["n"]) for r in got), key=str)


def steps(spark, tmp_path, prepare, run):
    """Run once undisturbed to count the writes; then, for each of them, from a copy
    of the same start: stop there, and hand the store to a clean run."""
    start = Stopping(spark, str(tmp_path / "start"))
    prepare(start)

    def copy(name):
        shutil.copytree(start.root, tmp_path / name)
        return Stopping(spark, str(tmp_path / name))

    st = copy("count")
    run(st)
    n = st.writes
    assert n > 2
    for k in range(1, n + 1):
        st = copy(f"stop{k}")
        st.stop = k
        with pytest.raises(Stopped):
            run(st)
        yield Stopping(spark, st.root)


def test_load(spark, tmp_path):
    src = folder(tmp_path)
    for st in steps(spark, tmp_path, lambda st: st.ensure(), lambda st: sync(spark, str(src), st)):
        sync(spark, str(src), st)
        assert_whole(st, [(2024, 1, 9), (2024, 2, 3), (2024, 3, 2), (None, None, 1)], ["a_202401.csv", "b_202401.csv", "c_202403.csv"])


@pytest.mark.parametrize("match", ["month", "file"])
def test_removal(spark, tmp_path, match):
    src = folder(tmp_path)

    def prepare(st):
        write_csv(src / "a_202401.csv", month_rows(2024, 1, 5, geohash="a") + month_rows(2024, 2, 3, geohash="a"))
        sync(spark, str(src), st)
        os.remove(src / "a_202401.csv")

    left = {
        "month": [(2024, 2, 3), (2024, 3, 2), (None, None, 1)],
        "file": [(2024, 1, 4), (2024, 3, 2), (None, None, 1)],
    }[match]
    for st in steps(spark, tmp_path, prepare, lambda st: sync(spark, str(src), st, match=match)):
        sync(spark, str(src), st, match=match)
        assert_whole(st, left, ["b_202401.csv", "c_202403.csv"])


def test_repair(spark, tmp_path):
    """A load stopped once its rows are in, then a repair stopped at each write."""
    src = folder(tmp_path)

    def prepare(st):
        st.ensure()
        half = Stopping(spark, st.root)
        half.stop = 2  # rows written, no rollups, not marked loaded
        with pytest.raises(Stopped, match="rows"):
            sync(spark, str(src), half)

    for st in steps(spark, tmp_path, prepare, lambda st: st.recover(list_csv_files(spark, str(src)))):
        sync(spark, str(src), st)
        assert_whole(st, [(2024, 1, 9), (2024, 2, 3), (2024, 3, 2), (None, None, 1)], ["a_202401.csv", "b_202401.csv", "c_202403.csv"])
