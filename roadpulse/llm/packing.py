"""Packing by power-of-two decomposition.

A document's token ids and one closing id are cut, from the front, into pieces whose
lengths are powers of two: as many of ``SEQUENCE`` ids as fit, then one piece for
each bit of what is left, the longest first. A piece is a sequence of its own, so no
sequence crosses documents, and since its length is a power of two it needs no
padding. Sequences of equal length form a bucket, and a bucket's numbers
are in one range, so a reader takes batches of one shape from a range of numbers.

Tokenizing looks up *units*: the text is cut before every space that a character
other than white space follows. The tokenizer's own first split has a border at each
of these places, whatever stands around, so a unit has the same ids alone as in its
text. Each worker keeps the ids of the units it met (at most twice ``UNITS`` of them, none
longer than ``UNIT_CHARS``) and asks the tokenizer for the others.

Numbers need no shuffle and no second pass: a sequence's number is made of its bucket,
its task and its place among the task's pieces of that length, so the numbers of a
bucket are in one range and those of a task's pieces of one length follow each other.

Edge cases: a null text counts as empty; an empty text has the closing id alone, one
piece of length 1. Strings that the tokenizer knows as special tokens are ordinary
text. A very long text is cut as it is read, its ids held as four bytes each. Rows
that repeat a ``doc_id`` (or have none) are documents of their own. An empty table
gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
CLOSING_ID = 1
UNITS, UNIT_CHARS = 700_000, 64
# Bits of a sequence's number for the task, and for the place within the task.
TASK_BITS, PLACE_BITS = 24, 33
# Characters of a text cut into units at once.
SLICE = 1 << 20
# Pieces handed back at once.
ROWS_OUT = 4096

# U+180E is white space to some regular expression engines only.
_BORDER = re.compile("[ ](?=[^\\s\u180e])")
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Units:
    """Ids of units as little-endian unsigned 32-bit integers. A full table becomes the
    old one, from which units that are met again move to the new one."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.old = tokenizer, {}, {}

    def of(self, units: list[str]) -> bytes:
        """Ids of units that each follow a space; unknown ones are tokenized together."""
        unknown = set(units).difference(self.known)
        if len(self.known) + len(unknown) > UNITS:
            self.known, self.old = {}, self.known
            unknown = set(units)
        again = [u for u in unknown if u in self.old]
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new = list(unknown.difference(again))
        if new:
            # A token begins inside its unit: the space goes with what follows it.
            made = self.tokenizer.encode(" " + " ".join(new), add_special_tokens=False)
            begins = np.array([a for a, _ in made.offsets])
            cuts = np.searchsorted(begins, np.cumsum([0, *[len(u) + 1 for u in new]]))
            ids, cuts = packed(made.ids), (4 * cuts).tolist()
            self.known.update(zip(new, [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
        out = b"".join(map(self.known.__getitem__, units))
        for unit in new:
            if len(unit) > UNIT_CHARS:
                del self.known[unit]
        return out


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.units = Units(self.tokenizer)

    def ids(self, text: str) -> bytes:
        """Ids of a text, read in slices that end at a border."""
        out, start = [], 0
        while True:
            end = _BORDER.search(text, start + SLICE) if len(text) - start > SLICE else None
            units = _BORDER.split(text[start : end.start() if end else None])
            if start == 0:
                out.append(packed(self.tokenizer.encode(units.pop(0), add_special_tokens=False).ids))
            out.append(self.units.of(units))
            if end is None:
                return b"".join(out)
            start = end.end()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    whole, left = divmod(n, sequence)
    bits = [1 << b for b in range(sequence.bit_length() - 2, -1, -1)]
    return [sequence] * whole + [b for b in bits if left & b]


def _pieces(path: str, sequence: int, closing: int):
    end = packed([closing])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        made: dict[int, int] = {}
        rows: list[tuple] = []
        for given in batches:
            for doc, text in zip(given.column("doc_id").to_pylist(), given.column("text")):
                ids = encode.ids(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in lengths(n, sequence):
                    nth = made.get(length, 0)
                    made[length] = nth + 1
                    number = (((length.bit_length() - 1) << TASK_BITS | task) << PLACE_BITS) + nth
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, number, 0))
                    start += length
                    if len(rows) >= ROWS_OUT:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset: one row for each piece. ``sequence`` is a power of two;
    ``tokenizer`` the path of its file on every machine."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_pieces(tokenizer, sequence, closing), SCHEMA)
