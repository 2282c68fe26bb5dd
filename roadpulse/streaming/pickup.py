"""Incremental pick-up of new monthly files as a Structured Streaming job.

The stream is one of file names: the file source finds the files that came
since the last run (its checkpoint remembers them), and each micro-batch is
loaded into the store the way ``sync`` loads it, with the same reading, manifest
and rollups. A batch that is tried again after a lost driver finds its files in
the manifest and passes them over, or takes a half load back first, so no file
is counted twice. Runs with ``trigger(availableNow=True)`` and stops.

The checkpoint and the manifest are two records of what was picked up, and only the
manifest says what the store holds. So a run begins by bringing rows and manifest in
line (``TrafficStore.recover``), and ends by loading every file on disk that the manifest
still lacks although the checkpoint has it as seen: files of rows that were taken back
(a lost or older manifest), files that ``sync`` removed and that came back under their
name, and names the file source passes over.

This path covers additions only; removed files are handled by ``sync``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.csv_source import file_name, list_csv_files
from ..sources.store import TrafficStore
from ..sources.sync import new_files

# Soft cap on the bytes of new files per micro-batch (at least one file is
# always taken). Monthly files differ in size, so a byte cap bounds a batch,
# and the work redone when a batch is retried, better than a file count.
MAX_BYTES_PER_TRIGGER = 128 * 1024**3


def source_stream(spark: SparkSession, src_dir: str) -> DataFrame:
    """``path, filename`` of the CSV files directly in ``src_dir``; their content is
    not read here."""
    listing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.csv")
        .option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER)
        .load(src_dir)
    )
    return listing.select(F.col("path"), file_name().alias("filename"))


def missing(store: TrafficStore, names: DataFrame, src_dir: str) -> list[tuple[str, str]]:
    """Of these files (``filename``), those on disk that the manifest lacks: name and
    path as they are on disk (the file source gives them percent-encoded)."""
    lacking = new_files(names.select("filename").distinct(), store.manifest())
    on_disk = list_csv_files(store.spark, src_dir)
    return sorted((r["filename"], r["path"]) for r in lacking.join(on_disk, "filename").collect())


def load_batch(store: TrafficStore, src_dir: str, batch: DataFrame) -> int:
    """Load the files of a batch (``filename``) that the store does not have yet and
    that are still on disk; returns their number."""
    fresh = missing(store, batch, src_dir)
    if fresh:
        store.load(fresh)
    return len(fresh)


def pick_up(
    spark: SparkSession,
    src_dir: str,
    store: TrafficStore,
    checkpoint_dir: str,
    timeout_s: float | None = None,
    take_over: bool = False,
) -> int:
    """Load the files that are new since the last run into ``store``, then those on disk
    that it lacks for another reason; returns the number of micro-batches run. Raises
    ``TimeoutError`` when they are not done within ``timeout_s`` (a later run goes on from
    there) and ``StoreBusy`` while another run writes to the store."""
    batches = []

    def run(batch: DataFrame, number: int) -> None:
        load_batch(store, src_dir, batch)
        batches.append(number)

    with store.writing(take_over):
        store.ensure()
        store.recover(list_csv_files(spark, src_dir))
        q = (
            source_stream(spark, src_dir)
            .writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .start()
        )
        if q.awaitTermination(timeout_s) is False:
            q.stop()
            raise TimeoutError(f"files of '{src_dir}' not picked up within {timeout_s} s")
        if q.exception():
            raise q.exception()
        load_batch(store, src_dir, list_csv_files(spark, src_dir))
    return len(batches)
