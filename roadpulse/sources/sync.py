"""Keep the store in step with the source folder.

One run: hold the store for writing, list the CSV files (S2), bring rows and manifest in
line after whatever an earlier run left (``TrafficStore.recover``), read the manifest (S4), find removed files (S16) and
delete their month's rows (S7, by the ``YYYYMM`` in the name) and manifest
entries (S8), then find new files (S15), load them (S1, S5) and record them
(S6). Removals come before additions. Only file names are compared; size,
content and modification time are ignored.

Every step is recorded in the manifest before it touches rows and marked done
after its rows and rollups (see store.py). A second run on the same store raises
``StoreBusy``; ``take_over`` is for the store that a lost run still holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_source import list_csv_files
from .store import TrafficStore

# Fixed value: the first six consecutive digits of a file name are read as
# year (4) and month (2).
NAME_MONTH_PATTERN = r"(\d{4})(\d{2})"


def name_year(name: Column) -> Column:
    return F.regexp_extract(name, NAME_MONTH_PATTERN, 1).try_cast("int")


def name_month(name: Column) -> Column:
    return F.regexp_extract(name, NAME_MONTH_PATTERN, 2).try_cast("int")


def new_files(on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """S15: on disk, not yet loaded (by name)."""
    return on_disk.join(manifest.select("filename"), "filename", "left_anti")


def removed_files(manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """S16: loaded before, gone from disk now."""
    return manifest.join(on_disk.select("filename"), "filename", "left_anti")


def with_name_month(files: DataFrame) -> DataFrame:
    """P17: ``year, month`` parsed from each name (null without six digits)."""
    return files.select(
        "filename", name_year(F.col("filename")).alias("year"), name_month(F.col("filename")).alias("month")
    )


def months_of(files: DataFrame) -> DataFrame:
    """The months named by files; names without six digits give no row (so they
    delete nothing)."""
    parsed = with_name_month(files).select("year", "month")
    return parsed.where(F.col("year").isNotNull() & F.col("month").isNotNull()).distinct()


def without_months(traffic: DataFrame, months: DataFrame) -> DataFrame:
    """S7 as a DataFrame step: rows whose (year, month) is not in ``months``. The
    planner broadcasts the months while they are small by its own measure."""
    kept = traffic.join(months.select("year", "month"), ["year", "month"], "left_anti")
    return kept.select(*traffic.columns)


@dataclass
class SyncResult:
    loaded: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    dropped_months: list[tuple[int, int]] = field(default_factory=list)
    repaired: list[str] = field(default_factory=list)


def sync(
    spark: SparkSession,
    src_dir: str,
    store: TrafficStore,
    match: str = "month",
    rebalance: bool = False,
    take_over: bool = False,
) -> SyncResult:
    """Bring ``store`` in line with the ``*.csv`` files directly in ``src_dir``.

    ``match="month"`` (default) deletes, for each removed file, every row of the
    month named in the file name, as the reference does; ``match="file"``
    deletes exactly the rows that came from the removed file.

    ``rebalance=True`` shuffles new rows by month before writing, for sources
    whose files are not one month each (see ``TrafficStore.load``).

    Raises ``FileNotFoundError`` when the folder has no CSV file and nothing
    was loaded before.
    """
    if match not in ("month", "file"):
        raise ValueError("match must be 'month' or 'file'")
    with store.writing(take_over):
        disk = list_csv_files(spark, src_dir)
        store.ensure()
        result = SyncResult(repaired=store.recover(disk))
        before = store.manifest()
        # File names (one row per new or removed file) come to the driver because
        # new files are handed to a read and removed months to a folder each.
        gone = removed_files(before, disk).select("filename")
        gone = {r["filename"]: (r["year"], r["month"]) for r in with_name_month(gone).collect()}
        fresh = sorted((r["filename"], r["path"]) for r in new_files(disk, before).collect())
        # With an empty manifest every file on disk is new, so no new file means
        # no file at all.
        if not fresh and not gone and before.isEmpty():
            raise FileNotFoundError(f"no CSV files in '{src_dir}'")

        if gone:
            result.removed = sorted(gone)
            if match == "month":
                named = {n: [] if None in m else [m] for n, m in gone.items()}
                result.dropped_months = store.remove_months(named)
            else:
                result.dropped_months = store.remove_files(result.removed)
        if fresh:
            store.load(fresh, rebalance=rebalance)
            result.loaded = [n for n, _ in fresh]
    return result
