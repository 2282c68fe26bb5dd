import os
import shutil

import pytest
from fixtures import HEADER, month_rows, write_csv
from test_sync import assert_rollup_consistent, manifest_of, months_in

from roadpulse.sources.store import TrafficStore
from roadpulse.sources.sync import sync
from roadpulse.streaming import pickup
from roadpulse.streaming.pickup import pick_up


@pytest.fixture()
def place(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    return src, TrafficStore(spark, str(tmp_path / "store")), str(tmp_path / "ck")


def test_three_runs_add_only_new_files(spark, place):
    src, st, ck = place
    write_csv(src / "traffic density+_202401.csv", month_rows(2024, 1, 3))
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 3)]
    write_csv(src / "traffic_density_202402.csv", month_rows(2024, 2, 2))
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 3), (2024, 2, 2)]
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 3), (2024, 2, 2)]
    assert manifest_of(st) == ["traffic density+_202401.csv", "traffic_density_202402.csv"]
    assert_rollup_consistent(st)
    # The batch path finds nothing new.
    assert sync(spark, str(src), st).loaded == []


def test_same_reading_as_the_batch_load(spark, place):
    src, st, ck = place
    rows = month_rows(2024, 1, 2)
    rows[0]["AVERAGE_SPEED"] = 58.7
    write_csv(src / "traffic_density_202401.csv", rows, header=list(reversed(HEADER)))
    pick_up(spark, str(src), st, ck)
    assert sorted(r["AVERAGE_SPEED"] for r in st.table().collect()) == [31, 59]


def test_batch_tried_again_counts_once(spark, place, monkeypatch):
    """A batch that fails after the load is run again from the checkpoint."""
    src, st, ck = place
    write_csv(src / "traffic_density_202401.csv", month_rows(2024, 1, 3))
    load = pickup.load_batch

    def fails_after(*args):
        load(*args)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(pickup, "load_batch", fails_after)
    with pytest.raises(Exception):
        pick_up(spark, str(src), st, ck)
    monkeypatch.setattr(pickup, "load_batch", load)
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 3)]
    assert_rollup_consistent(st)


def test_byte_cap_splits_batches(spark, place, monkeypatch):
    """With a byte cap below one file, every new file is its own micro-batch;
    the loaded rows are the same."""
    monkeypatch.setattr(pickup, "MAX_BYTES_PER_TRIGGER", 1)
    src, st, ck = place
    for m in (1, 2, 3):
        write_csv(src / f"traffic_density_2024{m:02d}.csv", month_rows(2024, m, 2))
    assert pick_up(spark, str(src), st, ck) >= 3
    assert months_in(st) == [(2024, 1, 2), (2024, 2, 2), (2024, 3, 2)]


def test_timeout_is_an_error(spark, place, monkeypatch):
    import time

    src, st, ck = place
    write_csv(src / "traffic_density_202401.csv", month_rows(2024, 1, 2))
    load = pickup.load_batch
    monkeypatch.setattr(pickup, "load_batch", lambda *a: (time.sleep(3), load(*a)))
    with pytest.raises(TimeoutError):
        pick_up(spark, str(src), st, ck, timeout_s=0.5)
    monkeypatch.setattr(pickup, "load_batch", load)
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 2)]


def test_hidden_names_are_picked_up(spark, place):
    src, st, ck = place
    write_csv(src / "_traffic_202401.csv", month_rows(2024, 1, 2))
    pick_up(spark, str(src), st, ck)
    write_csv(src / "traffic_202402.csv", month_rows(2024, 2, 3))
    pick_up(spark, str(src), st, ck)
    assert months_in(st) == [(2024, 1, 2), (2024, 2, 3)]


def three(src, sizes=(4, 5, 3)):
    for m, n in enumerate(sizes, 1):
        write_csv(src / f"traffic_2024{m:02d}.csv", month_rows(2024, m, n))


def whole(st, sizes=(4, 5, 3)):
    assert months_in(st) == [(2024, m, n) for m, n in enumerate(sizes, 1)]
    assert manifest_of(st) == [f"traffic_2024{m:02d}.csv" for m in range(1, len(sizes) + 1)]
    assert_rollup_consistent(st)


def test_lost_manifest(spark, place):
    """The checkpoint has two files as seen; the manifest is gone; a third comes."""
    src, st, ck = place
    three(src, (4, 5))
    pick_up(spark, str(src), st, ck)
    shutil.rmtree(st.log.path)
    three(src)
    pick_up(spark, str(src), TrafficStore(spark, st.root), ck)
    whole(st)
    assert pick_up(spark, str(src), st, ck) == 0
    whole(st)


def test_lost_manifest_and_no_new_file(spark, place):
    src, st, ck = place
    three(src)
    pick_up(spark, str(src), st, ck)
    shutil.rmtree(st.log.path)
    pick_up(spark, str(src), TrafficStore(spark, st.root), ck)
    whole(st)


def test_lost_manifest_keeps_rows_without_a_file(spark, place):
    """Rows that cannot be read again stay, and count as loaded."""
    src, st, ck = place
    three(src)
    pick_up(spark, str(src), st, ck)
    shutil.rmtree(st.log.path)
    shutil.rmtree(st.rollup_path)
    os.remove(src / "traffic_202402.csv")
    pick_up(spark, str(src), TrafficStore(spark, st.root), ck)
    whole(st)


def test_older_manifest(spark, place):
    """A manifest put back from before the last load: its rows count once."""
    src, st, ck = place
    three(src, (4, 5))
    pick_up(spark, str(src), st, ck)
    shutil.copytree(st.log.path, f"{st.root}-old")
    three(src)
    pick_up(spark, str(src), st, ck)
    shutil.rmtree(st.log.path)
    shutil.copytree(f"{st.root}-old", st.log.path)
    pick_up(spark, str(src), TrafficStore(spark, st.root), ck)
    whole(st)


@pytest.mark.parametrize("match", ["month", "file"])
def test_file_removed_and_back(spark, place, match):
    src, st, ck = place
    three(src)
    pick_up(spark, str(src), st, ck)
    os.remove(src / "traffic_202401.csv")
    sync(spark, str(src), st, match=match)
    assert months_in(st) == [(2024, 2, 5), (2024, 3, 3)]
    three(src)
    pick_up(spark, str(src), st, ck)
    whole(st)


def test_lost_checkpoint(spark, place, tmp_path):
    src, st, ck = place
    three(src)
    pick_up(spark, str(src), st, ck)
    pick_up(spark, str(src), st, str(tmp_path / "another"))
    whole(st)
