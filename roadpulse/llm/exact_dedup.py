"""Exact duplicates by a tree merge of sorted digest runs.

Every text becomes a digest (SHA-256 of its A-Z lower-cased UTF-8 bytes, with its
length and a second, independent 64-bit hash, which verify that equal digests
mean equal texts). Tasks sort their rows' entries into runs, in which equal texts are one
entry already: the surviving identifier and the number of rows. A run is a sequence of
blocks of a few thousand entries (``Sizes``), a row each, and belongs to one of the holders.

Holders have numbers of ``ROUNDS`` or more digits of ``RADIX_BITS`` bits, as many as give
each about ``ENTRIES`` rows. In round k, holders whose numbers agree but for digit k
exchange runs: an entry goes to the partner whose digit k is that of its digest. A holder
merges what it gets from all partners: its blocks come ordered by their first entries, so
entries before the first entry of the next block are final, are folded where equal, and
go out as the sorted runs of the next round, which are written to the shared folder. A
task thus holds the overlap of its runs, a block of each, whatever their length. After
the last round a text is one entry of one holder. Copies are folded before every exchange,
so a text that fills a third of all rows sends a holder one entry for each run.

Kept: the row with the largest ``doc_id`` (``largest=False``: the smallest).

Edge cases: a null text counts as empty. Rows with a null ``doc_id`` count in
``group_size`` and are never kept while the group has another; a group without
any ``doc_id`` has ``keep_id`` null and keeps its rows. Rows that repeat the
surviving ``doc_id`` are all marked kept. An empty table gives no rows. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, written

RADIX_BITS, ROUNDS = 4, 2
ENTRIES = 2_000_000  # rows of a holder


@dataclass(frozen=True)
class Sizes:
    run: int = ENTRIES // 4  # entries that a task sorts at once
    block: int = 4096  # entries of a block
    held: int = 1 << 16  # entries that wait before a merge goes on


_DIGEST = ["digest", "length", "second"]
ENTRY = np.dtype([("digest", "<u8", 4), ("length", "<i8"), ("second", "<i8"), ("keep", "<i8"), ("known", "u1"), ("count", "<i8")])
_RUNS = "holder long, first binary, block binary"


def _digest(texts: pd.Series) -> pd.DataFrame:
    low = [encode(t).lower() for t in texts]  # of bytes: ASCII only
    return pd.DataFrame(
        {
            "digest": [hashlib.sha256(b).digest() for b in low],
            "length": [len(b) for b in low],
            "second": [xxhash.xxh64_intdigest(b) - (1 << 63) for b in low],
        }
    )


def digests(docs: DataFrame) -> DataFrame:
    udf = F.pandas_udf(_digest, "digest binary, length long, second long")
    made = docs.select("doc_id", udf("text").alias("d"))
    return made.select("doc_id", *[F.col(f"d.{c}") for c in _DIGEST])


def digest_bytes(entries: np.ndarray) -> list[bytes]:
    whole = entries["digest"].astype(">u8").tobytes()
    return [whole[i : i + 32] for i in range(0, len(whole), 32)]


def ordered(entries: np.ndarray) -> np.ndarray:
    d = entries["digest"]
    return entries[np.lexsort((entries["second"], entries["length"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))]


def folded(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Sorted entries with those of one text made one."""
    if not len(entries):
        return entries
    d = entries["digest"]
    new = (d[1:] != d[:-1]).any(axis=1) | (entries["length"][1:] != entries["length"][:-1]) | (entries["second"][1:] != entries["second"][:-1])
    first = np.append(0, np.flatnonzero(new) + 1)
    out = entries[first].copy()
    pick, worst = (np.maximum, np.iinfo(np.int64).min) if largest else (np.minimum, np.iinfo(np.int64).max)
    known = entries["known"] > 0
    out["keep"] = pick.reduceat(np.where(known, entries["keep"], worst), first)
    out["known"] = np.maximum.reduceat(entries["known"], first)
    out["count"] = np.add.reduceat(entries["count"], first)
    return out


class Sender:
    """Sorted entries of a holder to blocks for its partners of a round."""

    def __init__(self, holder: int, turn: int, bits: int, block: int):
        self.block = block
        self.shift, self.partners = turn * bits, 1 << bits
        self.rest = holder & ~((self.partners - 1) << self.shift)
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(self.partners)]

    def send(self, entries: np.ndarray, end: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
        digit = (entries["digest"][:, 3] >> np.uint64(self.shift)).astype(np.int64) & (self.partners - 1)
        for k in range(self.partners):
            self.waiting[k].append(entries[digit == k])
            size = sum(map(len, self.waiting[k]))
            if size >= self.block or end and size:
                run = np.concatenate(self.waiting[k])
                stop = size if end else size - size % self.block
                for i in range(0, stop, self.block):
                    part = run[i : min(i + self.block, stop)]
                    yield self.rest | k << self.shift, digest_bytes(part[:1])[0], part.tobytes()
                self.waiting[k] = [run[stop:]]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([b], pa.binary()) for b in row[1:]]], names=["holder", "first", "block"])


def first_runs(rows: DataFrame, rounds: int, bits: int, largest: bool, sizes: Sizes = Sizes()) -> DataFrame:
    """holder, first, block: the rows as sorted runs, sent to the partners of the first
    round. Runs of a task are dealt to holders one after the other."""
    holders = 1 << (rounds * bits)

    def runs(batches):
        task, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def sent():
            sender = Sender((task + n * 7919) % holders, 0, bits, sizes.block)
            return sender.send(folded(ordered(np.concatenate(waiting)), largest), end=True)

        for b in batches:
            made = np.zeros(b.num_rows, dtype=ENTRY)
            made["digest"] = np.frombuffer(b"".join(b.column("digest").to_pylist()), dtype=">u8").reshape(-1, 4)
            for c in ("length", "second"):
                made[c] = b.column(c).to_numpy()
            made["known"] = np.asarray(b.column("doc_id").is_valid())
            made["keep"] = b.column("doc_id").fill_null(0).to_numpy()
            made["count"] = 1
            waiting.append(made)
            size += len(made)
            if size >= sizes.run:
                yield from _batches(sent())
                n, waiting, size = n + 1, [], 0
        if size:
            yield from _batches(sent())

    return rows.select("doc_id", *_DIGEST).mapInArrow(runs, _RUNS)


def merged(blocks: Iterator[np.ndarray], largest: bool, held: int) -> Iterator[np.ndarray]:
    """Blocks of sorted runs, ordered by their first entries, as one sorted sequence in
    which each text is one entry."""
    waiting, size = [], 0
    for block in blocks:
        waiting.append(block)
        size += len(block)
        if size >= held:
            run = folded(ordered(np.concatenate(waiting)), largest)
            # What comes later is not before the first entry of the latest block.
            stop = int(np.searchsorted(run["digest"][:, 0], block["digest"][0, 0]))
            if stop:
                yield run[:stop]
            waiting, size = [run[stop:]], 0
    if waiting:
        yield folded(ordered(np.concatenate(waiting)), largest)


def _by_holder(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    rows = ((h, np.frombuffer(x.as_py(), dtype=ENTRY)) for b in batches for h, x in zip(b.column("holder").to_pylist(), b.column("block")))
    for holder, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield holder, (block for _, block in own)


def exchange(runs: DataFrame, turn: int, bits: int, largest: bool, sizes: Sizes = Sizes()) -> DataFrame:
    """A round: every holder merges the runs it was sent and sends the next round's."""

    def made(batches):
        for holder, blocks in _by_holder(batches):
            sender = Sender(holder, turn, bits, sizes.block)
            for part in merged(blocks, largest, sizes.held):
                yield from _batches(sender.send(part))
            yield from _batches(sender.send(np.empty(0, dtype=ENTRY), end=True))

    return _delivered(runs).mapInArrow(made, _RUNS)


def _delivered(runs: DataFrame) -> DataFrame:
    return runs.repartition("holder").sortWithinPartitions("holder", "first")


def last_merge(runs: DataFrame, largest: bool, sizes: Sizes = Sizes()) -> DataFrame:
    """digest, length, second, keep_id, group_size: each text once."""

    def made(batches):
        for _, blocks in _by_holder(batches):
            for part in merged(blocks, largest, sizes.held):
                keep = pa.array(part["keep"], mask=part["known"] == 0)
                digest = pa.array(digest_bytes(part), pa.binary())
                columns = [digest, *[pa.array(np.ascontiguousarray(part[c])) for c in ("length", "second")], keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ascontiguousarray(part["count"]))], names=[*_DIGEST, "keep_id", "group_size"])

    return _delivered(runs).mapInArrow(made, "digest binary, length long, second long, keep_id long, group_size long")


def rounds_for(n: int, bits: int = RADIX_BITS) -> int:
    """Rounds after which a holder has about ``ENTRIES`` of ``n`` rows."""
    rounds = ROUNDS
    while n > ENTRIES << (rounds * bits):
        rounds += 1
    return rounds


def tree_merge(rows: DataFrame, rounds: int = ROUNDS, bits: int = RADIX_BITS, largest: bool = True) -> DataFrame:
    """digest, length, second, keep_id, group_size: one row for each text."""
    runs = written(first_runs(rows, rounds, bits, largest), "digest-runs")
    for turn in range(1, rounds):
        runs = written(exchange(runs, turn, bits, largest), "digest-runs")
    return last_merge(runs, largest)


def exact_duplicates(docs: DataFrame, largest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    rows = written(digests(docs), "digests")
    texts = tree_merge(rows, rounds_for(rows.count()), largest=largest)
    return rows.join(texts, _DIGEST).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
