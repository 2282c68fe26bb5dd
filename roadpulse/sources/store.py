"""The persistent store: measurements as Parquet partitioned by ``year, month, load``,
two rollups partitioned alike, and the manifest of loaded files.

Layout under ``root``::

    traffic/year=YYYY/month=M/load=<load>/part-*.parquet
    rollup/year=YYYY/month=M/load=<load>/part-*.parquet          (see plans/rollup.py)
    segment_rollup/year=YYYY/month=M/load=<load>/part-*.parquet  (see plans/segment_rollup.py)
    imported_files/                                              (see manifest.py)
    staging/                                                     (only while a load runs)

A load is one reading of one source file: ``<run>.<hash of the file's name>``. Its rows lie
in folders of their own, in all three tables, so

* a load writes its rows where they stay and moves nothing; they count once the
  manifest has the file as loaded, and reads leave out the loads that are under way;
* removing a file deletes its load's folders and reads or writes no rows;
* removing a month deletes the month's folders.

Every step is entered in the manifest before it touches rows and again when it is done.
``recover``, which every run begins with, compares the folders with the manifest: it ends
removals, and deletes what belongs to no loaded file, so that those files count as new
again. Rows that no entry explains and whose file is no longer there to be read again
(a lost manifest) are kept and entered as loaded.

With ``table_name`` the store is also a table of the session's catalog: its partitions are
added when a load is published and dropped before a removal, so SQL reads what the
manifest has as loaded, and prunes months without listing folders.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (
    LOAD,
    LOAD_FIELD,
    LOADED_COLUMNS,
    PARTITION_COLUMNS,
    SOURCE_FILE,
    STORE_PARTITIONS,
    STORED_COLUMNS,
    STORED_SCHEMA,
    TRAFFIC_COLUMNS,
    mark_partitions,
)
from ..plans.rollup import ROLLUP_COLUMNS, ROLLUP_SCHEMA, bounds_from_rollup, build_rollup
from ..plans.segment_rollup import SEGMENT_ROLLUP_COLUMNS, SEGMENT_ROLLUP_SCHEMA, build_segment_rollup
from ..operators.filters import DateRange
from ..operators.reports import date_bounds
from . import files
from .csv_source import read_csv_files, to_stored
from .manifest import GONE, LOADED, LOADING, REMOVING_FILE, REMOVING_MONTH, FileEntry, Manifest

STORED_ROLLUP = T.StructType(ROLLUP_SCHEMA.fields + [LOAD_FIELD])
STORED_SEGMENTS = T.StructType(SEGMENT_ROLLUP_SCHEMA.fields + [LOAD_FIELD])
# Upper bound on rows per written file, so one hot month still becomes many
# files of bounded size.
MAX_RECORDS_PER_FILE = 5_000_000
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
# Partitions named in one catalog statement.
CATALOG_BATCH = 200

Month = tuple[int | None, int | None]


def month_glob(rng: DateRange) -> str | None:
    """Glob of the month folders a day range touches, relative to a
    ``year=/month=`` partitioned folder: ``{year=Y/month={m,...},...}`` (``*``
    for whole years). ``None`` for a range that touches no month."""
    by_year: dict[int, list[int]] = defaultdict(list)
    y, m = rng.start.year, rng.start.month
    while y * 100 + m <= rng.end.year * 100 + rng.end.month:
        by_year[y].append(m)
        y, m = y + (m == 12), m % 12 + 1
    if not by_year:
        return None
    parts = [
        f"year={y}/month=" + ("*" if len(ms) == 12 else "{" + ",".join(map(str, ms)) + "}")
        for y, ms in by_year.items()
    ]
    return "{" + ",".join(parts) + "}"


def month_folder(month: Month) -> str:
    y, m = (NULL_FOLDER if v is None else int(v) for v in month)
    return f"year={y}/month={m}"


def load_of(run: str, name: str) -> str:
    """Load of a file by a run; ``load_column`` is the same on rows."""
    return f"{run}.{hashlib.md5(name.encode()).hexdigest()[:16]}"


def load_column(run: str, name: str = SOURCE_FILE) -> Column:
    return F.concat(F.lit(f"{run}."), F.substring(F.md5(F.col(name)), 1, 16))


def partition_of(folder: str) -> dict[str, str]:
    """``year``, ``month`` and ``load`` of a folder, as they are in its path."""
    return dict(re.findall(r"(year|month|load)=([^/]+)", folder))


def month_of(folder: str) -> Month:
    at = partition_of(folder)
    return tuple(None if at[c] == NULL_FOLDER else int(at[c]) for c in PARTITION_COLUMNS)


def _ordered(months: Iterable[Month]) -> list[Month]:
    return sorted(set(months), key=lambda m: (m[0] is None, m[0] or 0, m[1] or 0))


class TrafficStore:
    def __init__(self, spark: SparkSession, root: str, table_name: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.table_path = f"{self.root}/traffic"
        self.rollup_path = f"{self.root}/rollup"
        self.segment_rollup_path = f"{self.root}/segment_rollup"
        self.log = Manifest(spark, f"{self.root}/imported_files")
        self.table_name = table_name

    @property
    def _paths(self) -> tuple[str, str, str]:
        return self.table_path, self.rollup_path, self.segment_rollup_path

    def _done(self, step: str) -> None:
        """Called after each write of a step (tests stop a run here)."""

    def writing(self, take_over: bool = False):
        """Hold the store for a run that writes (``Manifest.writing``)."""
        return self.log.writing(take_over)

    # -- S3: create if missing ------------------------------------------------
    def ensure(self) -> "TrafficStore":
        """Create the folders, a rollup that is missing (from the rows), and the catalog
        table if the store has a name."""
        lacking = [p for p in self._paths if not files.exists(self.spark, p)]
        for path in (*self._paths, self.log.path):
            files.make(self.spark, path)
        if lacking and self.table_path not in lacking:
            self._write_rollups(self.stored(), lacking)
        if self.table_name and not self.spark.catalog.tableExists(self.table_name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED_SCHEMA.fields)
            self.spark.sql(
                f"CREATE TABLE {self.table_name} ({columns}) USING parquet "
                f"PARTITIONED BY ({', '.join(STORE_PARTITIONS)}) LOCATION '{self.table_path}'"
            )
            found = self._folders(self.table_path)
            stray = set(self._stray(sorted({partition_of(f)["load"] for f in found})))
            self._publish([f for f in found if partition_of(f)["load"] not in stray])
        return self

    # -- S11 / S4: scans ---------------------------------------------------------
    def _read(self, path: str, schema, rng: DateRange | None) -> DataFrame:
        """Read a ``year=/month=`` partitioned folder. With ``rng``, only the
        month folders the range touches are listed and read (a path glob with
        ``basePath``, so the partition columns stay); a store of a million
        files is then not listed whole to open one view. Partition pruning and
        the reports' own range filters still apply on top."""
        base = files.literal(path)
        if rng is None:
            return self._visible(self.spark.read.schema(schema).parquet(base))
        glob = month_glob(rng)
        if glob is None:
            return self.spark.createDataFrame([], schema)
        try:
            return self._visible(self.spark.read.schema(schema).option("basePath", path).parquet(f"{base}/{glob}"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _month_range(self, path: str) -> DateRange | None:
        """First and last month that have rows to read, from the folder names."""
        hidden = self._hidden()

        def numbered(folder: str, name: str) -> list[tuple[int, str]]:
            found = [e for e in files.entries(self.spark, folder) if e.is_dir and e.name.startswith(f"{name}=")]
            return sorted((int(v), e.path) for e in found if (v := e.name[len(name) + 1 :]).lstrip("-").isdigit())

        def end(backwards: bool) -> str | None:
            for year, folder in numbered(path, "year")[:: -1 if backwards else 1]:
                for month, inner in numbered(folder, "month")[:: -1 if backwards else 1]:
                    loads = [e.name.removeprefix("load=") for e in files.entries(self.spark, inner) if e.is_dir]
                    if any(not hidden(load) for load in loads):
                        return f"{year:04d}-{month:02d}-01"
            return None

        first = end(False)
        return None if first is None else DateRange.of(first, end(True))

    def _first_and_last(self, path: str, schema) -> DataFrame:
        """The rows of the first and the last month."""
        ends = self._month_range(path)
        if ends is None:
            return self.spark.createDataFrame([], schema)
        base = files.literal(path)
        paths = [f"{base}/{month_folder((d.year, d.month))}" for d in sorted({ends.start, ends.end})]
        return self._visible(self.spark.read.schema(schema).option("basePath", path).parquet(*paths))

    def _under_way(self) -> tuple[list[str], list[str]]:
        """Runs that load, and loads that are being removed: normally none, else those
        of the one run that writes."""
        open_ = self.log.unfinished()
        runs = sorted({e.load.split(".")[0] for e in open_ if e.state == LOADING})
        return runs, [e.load for e in open_ if e.state == REMOVING_FILE]

    def _hidden(self):
        runs, going = self._under_way()
        return lambda load: load in going or load.split(".")[0] in runs

    def _visible(self, rows: DataFrame) -> DataFrame:
        """Without the rows of steps under way (filters on the partition column)."""
        runs, going = self._under_way()
        for run in runs:
            rows = rows.where(~F.col(LOAD).startswith(f"{run}."))
        return rows.where(~F.col(LOAD).isin(going)) if going else rows

    def stored(self, rng: DateRange | None = None) -> DataFrame:
        """All stored columns, ``source_file`` included (optionally only the
        months ``rng`` touches)."""
        return self._read(self.table_path, STORED_SCHEMA, rng)

    def table(self, rng: DateRange | None = None) -> DataFrame:
        """The ``traffic`` table the reports read (no ``source_file``); its
        ``year``/``month`` carry the partition mark (schema.PARTITION_MARK).
        With ``rng``, only the month folders the range touches are read."""
        return self.stored(rng).select(*mark_partitions(TRAFFIC_COLUMNS))

    def date_bounds(self) -> DataFrame:
        """Q1 on the store: every row's month is derived from its timestamp, so
        the earliest and the latest measurement lie in the first and the last
        month folder, and only those two are read."""
        return date_bounds(self._first_and_last(self.table_path, STORED_SCHEMA))

    def rollup(self, rng: DateRange | None = None) -> DataFrame:
        """The rollup of the stored rows (plans/rollup.py)."""
        return self._read(self.rollup_path, STORED_ROLLUP, rng).select(*mark_partitions(ROLLUP_COLUMNS))

    def segment_rollup(self, rng: DateRange | None = None) -> DataFrame:
        """The per-segment, per-month rollup (plans/segment_rollup.py)."""
        return self._read(self.segment_rollup_path, STORED_SEGMENTS, rng).select(
            *mark_partitions(SEGMENT_ROLLUP_COLUMNS)
        )

    def view(self, date_value=None, threshold: int = 20):
        """A dashboard view on the store, as the page opens it: data bounds
        from the first and last month of the rollup, the picked dates resolved
        to a checked range, then the figures over reads of only the month
        folders in that range: cell figures from the rollup, hotspots and map
        from the segment rollup plus the rows of those edge months that reach
        beyond the range."""
        from ..plans.dashboard import Page, resolve_range
        from ..plans.rollup import month_spans

        row = bounds_from_rollup(self._first_and_last(self.rollup_path, STORED_ROLLUP)).first()
        rng = resolve_range(date_value, threshold, (row["d_min"], row["d_max"]))
        rollup = self.rollup(rng)
        return Page(
            self.table(rng),
            rng,
            threshold,
            rollup=rollup,
            segment_rollup=self.segment_rollup(rng),
            spans=month_spans(rollup, rng),
        )

    def manifest(self) -> DataFrame:
        """Loaded file names, one row each."""
        return self.log.table().where(F.col("state") == LOADED).select("filename").dropDuplicates(["filename"])

    # -- folders -----------------------------------------------------------------
    def _folders(self, path: str, loads: str = "*") -> list[str]:
        return files.folders(self.spark, f"{files.literal(path)}/year=*/month=*/load={loads}")

    def _delete_loads(self, loads: Iterable[str]) -> list[Month]:
        """Delete the loads' folders in the three tables; the months of their rows."""
        loads, months = set(loads), []
        for path in self._paths:
            gone = [f for f in self._folders(path) if partition_of(f)["load"] in loads]
            if path == self.table_path:
                self._withdraw(gone)
                months = [month_of(f) for f in gone]
            for f in gone:
                files.delete(self.spark, f)
            self._done("deleted")
        return _ordered(months)

    # -- the catalog table -------------------------------------------------------
    def _catalog(self, folders: list[str], verb: str) -> None:
        if not self.table_name or not self.spark.catalog.tableExists(self.table_name):
            return
        at = [partition_of(f) for f in folders]
        specs = [
            "PARTITION ({})".format(
                ", ".join([*(f"{c}={'null' if p[c] == NULL_FOLDER else p[c]}" for c in PARTITION_COLUMNS), f"{LOAD}='{p[LOAD]}'"])
            )
            for p in at
        ]
        between = " " if verb.startswith("ADD") else ", "
        for i in range(0, len(specs), CATALOG_BATCH):
            self.spark.sql(f"ALTER TABLE {self.table_name} {verb} {between.join(specs[i : i + CATALOG_BATCH])}")

    def _publish(self, folders: list[str]) -> None:
        self._catalog(folders, "ADD IF NOT EXISTS")

    def _withdraw(self, folders: list[str]) -> None:
        self._catalog(folders, "DROP IF EXISTS")

    # -- S5 / S6: loads --------------------------------------------------------
    def load(self, found: list[tuple[str, str]], rebalance: bool = False) -> None:
        """Load files, given as (name, path), that are not in the manifest.

        Monthly source files need no shuffle: every split of a file holds one
        month, so each task writes into one folder. With ``rebalance`` (for
        sources whose files mix months) the rows are shuffled once by month
        with a rebalance hint, so a task does not open a file in every month
        it meets; AQE cuts a hot month into several tasks of the advisory size
        and merges small ones.
        """
        staging = f"{self.root}/staging/{uuid.uuid4().hex[:12]}"
        rows = to_stored(read_csv_files(self.spark, found, staging))
        self.load_rows(rows, [n for n, _ in found], rebalance)
        files.delete(self.spark, staging)

    def load_rows(self, rows: DataFrame, names: list[str], rebalance: bool = False) -> None:
        """Load rows (``LOADED_COLUMNS``) that come from the files ``names``."""
        if rebalance:
            rows = rows.hint("rebalance", *PARTITION_COLUMNS)
        with self.writing():
            run = f"{self.log.next_version:08d}{uuid.uuid4().hex[:6]}"
            entries = [FileEntry(n, LOADING, load_of(run, n)) for n in names]
            self.log.change(entries, under_way=True)
            self._done("recorded")
            try:
                self._write(rows.select(*LOADED_COLUMNS, load_column(run).alias(LOAD)), self.table_path, STORED_COLUMNS)
                self._done("rows")
                self._write_rollups(self._of_run(run))
            finally:
                if not self.log.held():  # taken over meanwhile: nobody else knows of these rows
                    self._delete_loads(e.load for e in entries)
                    self.log.check()
            self.log.change([FileEntry(e.filename, LOADED, e.load) for e in entries], under_way=False)
            self._done("loaded")
            if self.table_name:
                self._publish(self._folders(self.table_path, f"{run}.*"))

    def _of_run(self, run: str) -> DataFrame:
        """The rows a run has written."""
        try:
            read = self.spark.read.schema(STORED_SCHEMA).option("basePath", self.table_path)
            return read.parquet(f"{files.literal(self.table_path)}/year=*/month=*/load={run}.*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], STORED_SCHEMA)
            raise

    def _write_rollups(self, rows: DataFrame, only: Iterable[str] | None = None) -> None:
        """Both rollups (or those of the paths ``only``) of the given stored rows, each
        one aggregate over the few columns it needs."""
        for build, path, columns in (
            (build_rollup, self.rollup_path, ROLLUP_COLUMNS),
            (build_segment_rollup, self.segment_rollup_path, SEGMENT_ROLLUP_COLUMNS),
        ):
            if only is not None and path not in only:
                continue
            # A month of the calendar rollup is bounded, one of the segment rollup grows
            # with the segments: the rebalance shuffle gives a small month one task and
            # cuts a large one into tasks of the advisory size.
            rolled = build(rows, STORE_PARTITIONS).hint("rebalance", *PARTITION_COLUMNS)
            self._write(rolled, path, [*columns, LOAD])
            self._done("rollup")

    @staticmethod
    def _write(rows: DataFrame, path: str, columns: list[str]) -> None:
        writer = rows.select(*columns).write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        writer.partitionBy(*STORE_PARTITIONS).parquet(path)

    # -- S7 / S8: removals -----------------------------------------------------
    def remove_months(self, removed: dict[str, list[Month]]) -> list[Month]:
        """Removed files, each with the months its name stands for: delete those
        months, then the manifest entries."""
        with self.writing():
            entries = [FileEntry(n, REMOVING_MONTH, ",".join(f"{y}-{m}" for y, m in months)) for n, months in removed.items()]
            self.log.change(entries, under_way=True)
            self._done("recorded")
            months = self._drop_months(entries)
            self._forget(entries)
        return months

    def _drop_months(self, entries: list[FileEntry]) -> list[Month]:
        named = [m.split("-") for e in entries for m in (e.load or "").split(",") if m]
        months = _ordered((int(y), int(m)) for y, m in named)
        for path in self._paths if months else ():
            for m in months:
                folder = f"{path}/{month_folder(m)}"
                if path == self.table_path and self.table_name:
                    self._withdraw([e.path for e in files.entries(self.spark, folder)])
                files.delete(self.spark, folder)
            self._done("deleted")
        return months

    def _forget(self, entries: list[FileEntry]) -> None:
        self.log.change([FileEntry(e.filename, GONE) for e in entries], under_way=False)
        self._done("forgotten")

    def remove_files(self, names: list[str]) -> list[Month]:
        """Delete exactly the rows that came from the given files, then their
        manifest entries; no other file's rows are read or written. Returns the months
        that had such rows."""
        with self.writing():
            asked = self.spark.createDataFrame([(n,) for n in names], "filename string")
            known = self.log.table().join(asked, "filename", "left_semi").select("filename", "load").collect()
            entries = [FileEntry(r["filename"], REMOVING_FILE, r["load"]) for r in known]
            self.log.change(entries, under_way=True)
            self._done("recorded")
            months = self._delete_loads(e.load for e in entries)
            self._forget(entries)
        return months

    # -- recovery ----------------------------------------------------------------
    def recover(self, on_disk: DataFrame) -> list[str]:
        """Bring rows and manifest in line after whatever an earlier run left; the names
        of files (of ``on_disk``: filename) that have to be loaded again.

        Half loads are deleted and removals ended. Folders of loads that the manifest
        does not know (it was lost, or an older one was put back) are deleted if their
        file is there to be read again; otherwise their rows are kept, their rollups
        made anew, and the file is entered as loaded.
        """
        with self.writing():
            open_ = self.log.unfinished()
            self._drop_months([e for e in open_ if e.state == REMOVING_MONTH])
            again = [e for e in open_ if e.state == LOADING]
            files.delete(self.spark, f"{self.root}/staging")
            found = sorted({partition_of(f)["load"] for p in self._paths for f in self._folders(p)})
            stray = self._stray(found)
            names = self._names_of(stray, on_disk, [e.load for e in open_ if e.state != REMOVING_MONTH])
            kept = {n: load for n, load, there in names if not there}
            back = sorted({n for n, _, there in names if there} | {e.filename for e in again})
            if stray:
                self._delete_loads(set(stray) - set(kept.values()))
            if kept:
                self._rebuild_rollups(list(kept.values()))
            ended = [FileEntry(e.filename, GONE) for e in open_ if e.filename not in kept]
            entered = [FileEntry(n, LOADED, load) for n, load in sorted(kept.items())]
            if open_ or kept:
                self.log.change(ended + entered, under_way=False)
                self._done("recovered")
        return back

    def _stray(self, found: list[str]) -> list[str]:
        """Loads that have folders but are not those of loaded files."""
        if not found:
            return []
        loaded = self.log.table().where(F.col("state") == LOADED).select("load")
        have = self.spark.createDataFrame([(f,) for f in found], "load string")
        return [r["load"] for r in have.join(loaded, "load", "left_anti").collect()]

    def _names_of(self, stray: list[str], on_disk: DataFrame, known: list[str]) -> list[tuple[str, str, bool]]:
        """File name, load, and whether the file can be read again, of stray loads that
        no open step explains. Reads one narrow column of those loads' folders."""
        asked = set(stray) - set(known)
        paths = [files.literal(f) for f in self._folders(self.table_path) if partition_of(f)["load"] in asked]
        if not paths:
            return []
        rows = self.spark.read.schema(STORED_SCHEMA).option("basePath", self.table_path).parquet(*paths)
        loaded = self.log.table().where(F.col("state") == LOADED).select("filename")
        there = on_disk.select("filename").union(loaded).distinct().withColumn("there", F.lit(True))
        names = rows.select(F.col(SOURCE_FILE).alias("filename"), LOAD).distinct().join(there, "filename", "left")
        return [(r["filename"], r[LOAD], bool(r["there"])) for r in names.orderBy(LOAD).collect()]

    def _rebuild_rollups(self, loads: list[str]) -> None:
        wanted = set(loads)
        for path in (self.rollup_path, self.segment_rollup_path):
            for f in self._folders(path):
                if partition_of(f)["load"] in wanted:
                    files.delete(self.spark, f)
        paths = [files.literal(f) for f in self._folders(self.table_path) if partition_of(f)["load"] in wanted]
        self._write_rollups(self.spark.read.schema(STORED_SCHEMA).option("basePath", self.table_path).parquet(*paths))
