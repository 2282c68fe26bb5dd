"""Helpers shared by the operators: session settings, tables, intermediate
tables in the shared folder, and blocks of text for array work in tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, override, scratch_dir

# Rows and bytes of one Arrow batch handed to a Python worker, so a batch of very
# long texts stays small beside a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
# Text bytes handled at once by array code in a task; its arrays take up to about
# thirty times as much.
BLOCK_BYTES = 512 << 10


def _ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run, once a session:
    a zip of its source, which Spark hands to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_roadpulse_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="roadpulse-code-"), "roadpulse.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._roadpulse_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators, until other work configures the session; ships
    their code to the workers. Steps end in written tables, so the shuffle files of a
    finished step are of no further use and go at once."""
    configure(spark)
    _ship(spark)
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": True,
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
    }
    override(spark, settings)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, and
    still there when an executor is lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text"):
    """64-bit key of a text (null apart from empty), to tell apart rows that
    repeat a ``doc_id``."""
    c = F.col(text)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.xxhash64(c))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample(docs: DataFrame, known: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """doc_id, text, the label column of ``known`` (doc_id, one label) and times, for
    learning: rows that repeat document, text and label are one row, ``times`` their number, at most ``most`` of them by hash of their
    ``doc_id``, and of these as many, in that order, as have ``most_bytes`` of text.
    Labels and sizes are chosen first, so no more text than that is brought together."""
    label = next(c for c in known.columns if c != "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", label]
    chosen = F.broadcast(known.orderBy(*order).limit(most))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    rows = docs.select("doc_id", text_key().alias("tkey"), size).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "tkey", "size", label).agg(F.count(F.lit(1)).alias("times"))
    # Of at most ``most`` rows: one task adds up their sizes.
    first = rows.orderBy(*order, "tkey").limit(most)
    so_far = F.sum("size").over(Window.orderBy(*order, "tkey").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = first.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "tkey", label, "times")
    texts = docs.select("doc_id", text_key().alias("tkey"), "text").join(F.broadcast(picked), ["doc_id", "tkey"])
    return texts.dropDuplicates(["doc_id", "tkey", label]).select("doc_id", "text", label, "times")


def numbered(rows: DataFrame, group: str, order: list[str], keep: list[Column], name: str) -> DataFrame:
    """``group``, the columns ``keep``, nth (from 0) and n (rows of the group) for rows
    ordered within their group; rows that ``order`` leaves equal stand side by side.

    No task holds a group: rows are sorted in ranges over all partitions, a group may lie
    in many, and the counts of its ranges give where the next one starts."""
    place = fresh(rows, "place")
    rows = rows.withColumn(place, F.monotonically_increasing_id())
    by = [group, *order, place]  # ascending puts nulls first
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = rows.select(group, *keep, F.monotonically_increasing_id().alias("at"))
    kept = written(kept.withColumn("part", F.shiftright("at", 33)), name)
    spans = kept.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy(group)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        group,
        "part",
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(own).alias("n"),
    )
    found = kept.join(spans, [group, "part"])
    return found.withColumn("nth", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def running_xor(rows: DataFrame, group: str, hashes: list[str], block: int) -> DataFrame:
    """``rows`` (with nth and n, as ``numbered`` makes them) and, for each column in
    ``hashes``, its exclusive-or over the rows of the group up to this one, under the name
    with ``_so_far``. Taken within blocks of ``block`` rows and over blocks, so a group of
    any size is many small ones."""
    rows = rows.withColumn("block", F.expr(f"nth div {block}"))
    of_block = rows.where(f"n > {block}").groupBy(group, "block").agg(*[F.bit_xor(h).alias(f"{h}_b") for h in hashes])
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_block = of_block.select(group, "block", *[F.bit_xor(f"{h}_b").over(before).alias(f"{h}_b") for h in hashes])
    within = Window.partitionBy(group, "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumns({f"{h}_w": F.bit_xor(h).over(within) for h in hashes})
    whole = inner.join(of_block, [group, "block"], "left")
    made = {f"{h}_so_far": F.col(f"{h}_w").bitwiseXOR(F.coalesce(f"{h}_b", F.lit(0))) for h in hashes}
    return whole.withColumns(made).drop("block", *[f"{h}_{x}" for h in hashes for x in "wb"])


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, cut into runs of at most ``limit`` bytes (at
    least one text each): (index of the first, texts). Null counts as empty."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = encode(t)
        if run and size + len(b) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(b)
        size += len(b)
    if run:
        yield start, run


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Random value of each byte, base of the polynomial token hash and its inverse
# modulo 2^64.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def tokens(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of a run of texts: (64-bit hash of each word, index of its text).
    A word is a longest run of ASCII letters, digits, ``_`` and non-ASCII
    characters; words never span texts."""
    buf = np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)
    word = _WORD[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, len(buf))[starts])
    limits = np.cumsum([len(t) + 1 for t in run])
    return h, np.searchsorted(limits, starts, side="right")
