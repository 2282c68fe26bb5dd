"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts
in a document with a smaller ``doc_id`` are removed.

Whether two places repeat each other is decided by suffix sorting
(``suffix_order``: Lyndon-prefix groups). What has to be sorted together is found
first, without loss:

* Each ``LENGTH``-byte window has an anchor: of the ``GRAM``-byte strings in it, the
  leftmost with the least hash. Equal windows have equal anchors at equal places.
  Neighbouring windows with the same anchor form a run, known by its anchor's hash
  (key) and the bytes around the anchor (context).
* Documents are read in batches, dealt out by a hash of ``doc_id``. Every batch
  sends its distinct keys to buckets, with the number of contexts of those that have
  several; keys that more than one document has go back to the batches that have
  them.
* Each batch sends the distinct contexts of those keys, with the smallest
  ``doc_id`` that has them, to the key's bucket. A key with one context has equal
  windows throughout. The contexts of all other keys are joined to one text, the
  anchor standing as one symbol; its suffixes are sorted, neighbours that agree
  over a whole window form a class, and the class's smallest ``doc_id`` goes
  back to the batches, which mark and cut.

Copies are folded within a batch before anything is sent, so a passage that a
third of all documents share is sent once by a batch. A key with more than
``CROWDED`` contexts, added up over the batches, is split: each of its windows gets a
key of its own, made from the window's bytes. So no key has more to sort than fits one
sort, also not that at the edge of a passage, whose context differs in every document.

A text of more than ``PIECE`` bytes is read in pieces, each with the ``LENGTH - 1`` bytes on
either side of it, so every window that covers a byte of a piece lies in it; the pieces go to
batches of their own and what is left of them is put together at the end. Rows that repeat
a ``doc_id`` go to batches by their texts. So a batch has about ``BATCH_TEXT`` bytes however
long a text is or however many texts share a ``doc_id`` (equal rows of one ``doc_id`` stay in
one batch).

Edge cases: null and empty texts have no bytes. Documents shorter than
``LENGTH`` bytes lose nothing. Rows that repeat a ``doc_id`` are one document to each
other: they remove nothing from one another. A null ``doc_id`` counts as larger
than all others; such rows remove nothing. An empty table gives no rows. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, encode, mix64, written
from .suffix_order import suffix_order

LENGTH, GRAM = 50, 36
REACH = LENGTH - GRAM  # most bytes of a window on either side of its anchor
BATCH_TEXT, BUCKET_TEXT = 2 << 20, 8 << 20
PIECE = 1 << 20
CHUNK = 1 << 16  # positions hashed at once; their arrays fit a core's cache
SORTED = 1 << 18  # symbols sorted at once
CROWDED = SORTED // (2 * REACH + 2)  # contexts of a key; each takes so many symbols at most
LARGEST = (1 << 63) - 1  # a null doc_id

_BASE = 0x9E3779B97F4A7C15
_SIDES = np.concatenate([np.arange(-REACH, 0), np.arange(GRAM, GRAM + REACH)])
_MIX = mix64(np.arange(1, 2 * REACH + 1, dtype=np.uint64)) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of the ``length`` bytes from each place on, by doubling."""
    doubled = {1: _BYTE[buf]}
    n = 1
    while 2 * n <= length:
        h = doubled[n]
        doubled[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    out, have = doubled[n], n
    while have < length:
        n = 1 << ((length - have).bit_length() - 1)
        more = doubled[n][have : have + len(out)]
        out = out[: len(more)] * _power(n) + more
        have += n
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


class Batch:
    """Documents of one batch in a fixed order, with their runs of windows."""

    def __init__(self, pdf: pd.DataFrame):
        ids = pdf["doc_id"].astype("Int64").fillna(LARGEST).to_numpy(dtype=np.int64)
        self.null = pdf["doc_id"].isna().to_numpy()
        texts = [t if isinstance(t, bytes) else encode(t) for t in pdf["text"]]
        order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k]))
        self.ids, self.null = ids[order], self.null[order]
        self.texts = [texts[k] for k in order]
        self.order = order
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.buf = np.frombuffer(b"".join(self.texts) + bytes(2 * LENGTH), dtype=np.uint8)
        self._runs()

    def _runs(self) -> None:
        """start, anchor (place of the gram), count (windows), key of each run."""
        fits = self.size >= LENGTH
        first = (self.end - self.size)[fits]
        mark = np.zeros(len(self.buf) + 1, dtype=np.int8)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + self.size[fits] - LENGTH + 1, -1)
        inside = np.cumsum(mark, dtype=np.int8)[:-1].astype(bool)
        begins = np.zeros(len(self.buf), dtype=bool)
        begins[first] = True
        total = len(self.buf) - 2 * LENGTH
        parts = []
        low = np.uint64(2 * CHUNK - 1)
        for at in range(0, total, CHUNK):
            stop = min(at + CHUNK, total)
            h = gram_hashes(self.buf[at : stop + LENGTH], GRAM)
            placed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            anchor = (_least(placed, REACH + 1)[: stop - at] & low).astype(np.int64)
            new = begins[at:stop].copy()
            new[0] = True
            new[1:] |= anchor[1:] != anchor[:-1]
            here = inside[at:stop]
            new[1:] |= here[1:] != here[:-1]
            edge = np.flatnonzero(new)
            count = np.diff(np.append(edge, stop - at))
            keep = here[edge]
            edge, count = edge[keep], count[keep]
            parts.append((edge + at, anchor[edge] + at, count, h[anchor[edge]] & ~np.uint64(1)))
        empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        self.start, self.anchor, self.count, self.key = (np.concatenate(p) for p in zip(*(parts or [empty])))
        runs = np.diff(np.append(np.searchsorted(self.start, self.end - self.size), len(self.start)))
        self.doc = np.repeat(np.arange(len(self.end)), runs)

    def shared_runs(self, shared: np.ndarray) -> "Entries":
        """The runs whose key is in ``shared`` (lowest bit: crowded)."""
        known = np.sort(shared)
        top = np.uint64(44)  # a table of the keys' first bits leaves most others out
        first = np.zeros(1 << 20, dtype=bool)
        first[known >> top] = True
        rows = np.flatnonzero(first[self.key >> top])
        at = np.searchsorted(known, self.key[rows])
        at[at == len(known)] = 0
        found = (known[at] & ~np.uint64(1)) == self.key[rows]
        rows, at = rows[found], at[found]
        start, anchor, count, key, doc = (v[rows] for v in (self.start, self.anchor, self.count, self.key, self.doc))
        crowded = (known[at] & np.uint64(1)).astype(bool)
        if crowded.any():
            n = np.where(crowded, count, 1)
            each = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            split = crowded[each]
            start, anchor, doc = start[each] + step, anchor[each], doc[each]
            count, key = np.where(split, 1, count[each]), key[each].copy()
            window = self.buf[start[split][:, None] + np.arange(LENGTH)]
            powers = np.array([int(_power(LENGTH - 1 - k)) for k in range(LENGTH)], dtype=np.uint64)
            key[split] = mix64((_BYTE[window] * powers).sum(axis=1, dtype=np.uint64)) & ~np.uint64(1)
        return Entries(self, start, anchor, count, key, doc)


class Entries:
    """Distinct (key, context) of a batch's shared runs, by bucket and identity."""

    def __init__(self, batch: Batch, start, anchor, count, key, doc):
        self.start, self.run_count, self.run_doc = start, count, doc
        before = anchor - start
        side = sides(batch.buf, anchor, before, count)
        identity = identities(side, before, count, key)
        order = np.argsort(identity)
        new = np.append(True, np.diff(identity[order]) != 0) if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.of_run = np.empty(len(order), dtype=np.int64)
        self.of_run[order] = np.cumsum(new) - 1
        rows = order[first]
        self.identity, self.key, self.count, self.before, self.side = identity[rows], key[rows], count[rows], before[rows], side[rows]
        ids = batch.ids[doc[order]]
        self.least = np.minimum.reduceat(ids, first) if len(first) else np.empty(0, np.int64)
        most = np.maximum.reduceat(ids, first) if len(first) else np.empty(0, np.int64)
        self.many = most > self.least

    def buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        return by_bucket(self.key, n)


def sides(buf, anchor, before, count) -> np.ndarray:
    """Bytes on both sides of the anchor that the run's windows cover."""
    side = buf[np.clip(anchor[:, None] + _SIDES, 0, len(buf) - 1)]
    left = np.arange(REACH) >= REACH - before[:, None]
    right = np.arange(REACH) < (count - 1 + REACH - before)[:, None]
    return np.where(np.concatenate([left, right], 1), side, 0).astype(np.uint8)


def identities(side, before, count, key) -> np.ndarray:
    """64-bit identity of (key, context)."""
    context = side.astype(np.uint64) @ _MIX + (before.astype(np.uint64) * 64 + count.astype(np.uint64))
    return mix64(mix64(context) + key)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (mix64(key >> np.uint64(1)) >> np.uint64(1)).astype(np.int64) % n


def by_bucket(key: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, rows) of the buckets that have rows, rows in order."""
    b = bucket_of(key, n)
    order = np.argsort(b.astype(np.uint16) if n <= 1 << 16 else b, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(b[order]) != 0)) if len(b) else []
    return [(int(b[r[0]]), r) for r in np.split(order, cut[1:])] if len(b) else []


_FIELDS = (("key", "<u8", 1), ("least", "<i8", 1), ("many", "u1", 1), ("before", "u1", 1), ("count", "u1", 1), ("side", "u1", 2 * REACH))
_RECORD = sum(np.dtype(t).itemsize * n for _, t, n in _FIELDS)


def _pack(e: Entries, rows: np.ndarray) -> bytes:
    """Entries field by field, compressed; their number goes before."""
    raw = b"".join(getattr(e, f)[rows].astype(t).tobytes() for f, t, _ in _FIELDS)
    return len(rows).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _packed(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _unpack(blobs) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {f: [] for f, _, _ in _FIELDS}
    for blob in blobs:
        m, at = _packed(blob), 0
        raw = pa.decompress(blob[8:], decompressed_size=m * _RECORD, codec="zstd", asbytes=True)
        for f, t, n in _FIELDS:
            v = np.frombuffer(raw, dtype=t, count=m * n, offset=at)
            parts[f].append(v.reshape(m, n) if n > 1 else v)
            at += v.nbytes
    e = {f: np.concatenate(v) for f, v in parts.items()}
    e["identity"] = identities(e["side"], e["before"], e["count"], e["key"])
    return e


def _keys_of(n_buckets: int):
    def keys(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(pdf)
        order = np.argsort(batch.key)
        k, ids = batch.key[order], batch.ids[batch.doc[order]]
        first = np.flatnonzero(np.append(True, np.diff(k) != 0)) if len(k) else np.empty(0, np.int64)
        many = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.empty(0, bool)
        made = k[first] | many.astype(np.uint64)
        n = contexts_of_keys(batch, order, first)
        rows = by_bucket(k[first], n_buckets)
        data = [made[r].tobytes() for _, r in rows]
        several = [_several(n[r]) for _, r in rows]
        return pd.DataFrame({"bucket": [b for b, _ in rows], "batch": key[0], "data": data, "several": several})

    return keys


def contexts_of_keys(batch: Batch, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct contexts of each key, for the runs by key and where each key begins."""
    runs = np.diff(np.append(first, len(order)))
    at = np.repeat(np.arange(len(runs)), runs)
    more = runs[at] > 1
    at, rows = at[more], order[more]
    start, anchor, count, key = (v[rows] for v in (batch.start, batch.anchor, batch.count, batch.key))
    identity = identities(sides(batch.buf, anchor, anchor - start, count), anchor - start, count, key)
    _, one = np.unique(identity, return_index=True)
    return np.maximum(np.bincount(at[one], minlength=len(runs)), 1)


def _several(n: np.ndarray) -> bytes:
    """Places and numbers of the keys that have more than one context."""
    at = np.flatnonzero(n > 1)
    return np.concatenate([at, n[at]]).astype("<i4").tobytes()


def _shared_of(crowded: int):
    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        data = [np.frombuffer(d, dtype=np.uint64) for d in pdf["data"]]
        k = np.concatenate(data)
        contexts = np.ones(len(k), dtype=np.int64)
        begin = 0
        for d, several in zip(data, pdf["several"]):
            at, number = np.frombuffer(several, dtype="<i4").reshape(2, -1)
            contexts[begin + at] = number
            begin += len(d)
        owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
        order = np.argsort(k)
        k, owner, contexts = k[order], owner[order], contexts[order]
        plain = k & ~np.uint64(1)
        first = np.flatnonzero(np.append(True, np.diff(plain) != 0))
        n = np.diff(np.append(first, len(k)))
        many = np.maximum.reduceat(k & np.uint64(1), first) > 0
        keep = np.repeat((n > 1) | many, n)
        made = (plain | np.repeat(np.add.reduceat(contexts, first) > crowded, n).astype(np.uint64))[keep]
        owner = owner[keep]
        back = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[back], np.arange(len(data) + 1))
        batches = pdf["batch"].to_numpy()
        rows = [(batches[i], made[back[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pd.DataFrame({"batch": [b for b, _ in rows], "bucket": -1, "data": [d for _, d in rows]})

    return shared


def _shared_keys(pdf: pd.DataFrame) -> np.ndarray:
    mine = pdf[pdf["bucket"] == -1]["data"]
    return np.frombuffer(b"".join(mine), dtype=np.uint64)


def _contexts_of(n_buckets: int):
    def contexts(key: tuple, docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(shared):
            e = Batch(docs).shared_runs(_shared_keys(shared))
            rows = [(b, _pack(e, r)) for b, r in e.buckets(n_buckets)]
        return pd.DataFrame({"bucket": [b for b, _ in rows], "batch": key[0], "data": [d for _, d in rows]})

    return contexts


def window_classes(side, before, count, key) -> np.ndarray:
    """Class of each window (of all contexts in turn): equal for windows with the
    same key and the same bytes. Contexts are distinct; those of a key are
    neighbours."""
    m = len(count)
    of_key = np.cumsum(np.append(0, np.diff(key) != 0))
    table = np.empty((m, 2 * REACH + 2), dtype=np.int64)
    table[:, :REACH] = side[:, :REACH].astype(np.int64) + 2
    table[:, REACH] = 258 + of_key
    table[:, REACH + 1 : -1] = side[:, REACH:].astype(np.int64) + 2
    table[:, -1] = 1
    col = np.arange(REACH)
    used = np.ones(table.shape, dtype=bool)
    used[:, :REACH] = col >= REACH - before[:, None]
    used[:, REACH + 1 : -1] = col < (count - 1 + REACH - before)[:, None]
    size = used.sum(axis=1)
    text = np.append(table[used], 0)
    begin = np.cumsum(size) - size
    window = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    number = np.full(len(text), -1, dtype=np.int64)
    number[window] = np.arange(len(window))
    order = number[suffix_order(text)]
    order = order[order >= 0]
    # Exact check of neighbours in the order, over the whole window.
    rows = text[window[order][:, None] + np.arange(REACH + 1)]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    out = np.empty(len(window), dtype=np.int64)
    out[order] = np.cumsum(np.append(0, ~same)) if len(order) else 0
    return out


def least_owners(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For entries (repeats allowed): the smallest doc_id of each window of each
    entry, flat, and where each entry's windows begin."""
    count = e["count"].astype(np.int64)
    order = np.lexsort((e["identity"], e["key"]))
    ident, key = e["identity"][order], e["key"][order]
    new = np.append(True, (np.diff(ident) != 0) | (np.diff(key) != 0))
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(e["least"][order], first)
    distinct = np.empty(len(order), dtype=np.int64)
    distinct[order] = np.cumsum(new) - 1
    rows = order[first]
    n = count[rows]
    at = np.cumsum(n) - n
    owner = np.repeat(least, n)
    k = e["key"][rows]
    size = np.bincount(np.cumsum(np.append(0, np.diff(k) != 0)))
    mixed = np.repeat(size > 1, size)
    todo = np.flatnonzero(mixed)
    # Whole keys, up to SORTED symbols at a time.
    symbols = np.cumsum(n[todo] + REACH + 1)
    starts = np.flatnonzero(np.append(True, np.diff(k[todo]) != 0)) if len(todo) else np.empty(0, np.int64)
    part = (symbols[starts] - 1) // SORTED if len(todo) else starts
    bounds = np.append(starts[np.append(True, np.diff(part) != 0)], len(todo)) if len(todo) else [0]
    for a, b in zip(bounds, bounds[1:]):
        some = todo[a:b]
        r = rows[some]
        cls = window_classes(e["side"][r], e["before"][r].astype(np.int64), n[some], k[some])
        where = np.repeat(at[some], n[some]) + np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        best = np.full(cls.max() + 1, LARGEST)
        np.minimum.at(best, cls, owner[where])
        owner[where] = best[cls]
    return owner, at[distinct]


def _owners(pdf: pd.DataFrame) -> pd.DataFrame:
    """What goes back to each batch for a bucket: a kind for each entry (0: it has
    the smallest doc_id in all windows and no other; 1: one smallest for all
    windows; 2: one for each), then those numbers."""
    e = _unpack(pdf["data"])
    owner, at = least_owners(e)
    count = e["count"].astype(np.int64)
    last = np.cumsum([_packed(d) for d in pdf["data"]])
    rows = []
    for batch, bucket, a, b in zip(pdf["batch"], pdf["bucket"], np.append(0, last[:-1]), last):
        n = count[a:b]
        begin = np.cumsum(n) - n
        flat = owner[np.repeat(at[a:b], n) + np.arange(n.sum()) - np.repeat(begin, n)]
        low, high = np.minimum.reduceat(flat, begin), np.maximum.reduceat(flat, begin)
        kind = np.where(low != high, 2, np.where((low < e["least"][a:b]) | (e["many"][a:b] > 0), 1, 0)).astype(np.uint8)
        if kind.any():
            wanted = np.repeat(kind == 2, n)
            wanted[begin[kind == 1]] = True
            rows.append((batch, bucket, kind.tobytes() + flat[wanted].astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["batch", "bucket", "data"])


_CUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "row", "piece", "edges"]


def _cut_of(n_buckets: int, size: int):
    def cut(key: tuple, docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(docs)
        gone = np.zeros(len(batch.buf), dtype=bool)
        owners = {b: d for b, d in zip(back["bucket"], back["data"]) if b >= 0}
        if owners:
            e = batch.shared_runs(_shared_keys(back))
            smallest = e.least.copy()
            flat = np.repeat(smallest, e.count)
            begin = np.cumsum(e.count) - e.count
            for b, rows in e.buckets(n_buckets):
                if b not in owners:
                    continue
                kind = np.frombuffer(owners[b], dtype=np.uint8, count=len(rows))
                value = np.frombuffer(owners[b], dtype="<i8", offset=len(rows))
                n = np.where(kind == 2, e.count[rows], kind)
                at = np.cumsum(n) - n
                for one, width in ((1, None), (2, 2)):
                    r = np.flatnonzero(kind == one)
                    c = e.count[rows[r]]
                    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    flat[np.repeat(begin[rows[r]], c) + step] = value[np.repeat(at[r], c) + (step if width else 0)]
            n = e.run_count
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lost = flat[np.repeat(begin[e.of_run], n) + step] < np.repeat(batch.ids[e.run_doc], n)
            places = (np.repeat(e.start, n) + step)[lost]
            hit = np.bincount(places, minlength=len(batch.buf))
            hit[LENGTH:] -= hit[:-LENGTH].copy()  # places that begin, less those that end
            gone = np.cumsum(hit) > 0
        out = []
        whole, piece, row = (docs[c].to_numpy()[batch.order] for c in ("whole", "piece", "row"))
        lead = np.minimum(piece * size, LENGTH - 1)
        for i, (text, end) in enumerate(zip(batch.texts, batch.end)):
            first = end - len(text) + lead[i]
            own = gone[first : first + min(size, whole[i] - piece[i] * size)]
            text = text[lead[i] : lead[i] + len(own)]
            removed = int(np.count_nonzero(own))
            spans = int(np.count_nonzero(own & np.append(True, ~own[:-1]))) if removed else 0
            edges = int(len(own) > 0 and own[0]) + 2 * int(len(own) > 0 and own[-1])
            kept = text if not removed else np.frombuffer(text, dtype=np.uint8)[~own].tobytes()
            out.append((None if batch.null[i] else int(batch.ids[i]), whole[i], removed, spans, kept, row[i], piece[i], edges))
        return pd.DataFrame(out, columns=_CUT).astype({"doc_id": "Int64"})

    return cut


def pieces(docs: DataFrame, size: int, long: bool) -> DataFrame:
    """doc_id, text (bytes), whole (bytes of the document's text), row, piece; with
    ``long``, texts of more than ``size`` bytes in pieces."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    whole = F.octet_length(data).cast("long")
    if not long:
        zero = F.lit(0).cast("long")
        return docs.select("doc_id", data.alias("text"), whole.alias("whole"), zero.alias("row"), zero.alias("piece"))
    side = LENGTH - 1

    def cut(k):
        lead = F.least(k * size, F.lit(side))
        return F.struct(k.alias("piece"), F.substring(data, (k * size - lead + 1).cast("int"), (lead + size + side).cast("int")).alias("text"))

    last = F.greatest(F.lit(0).cast("long"), F.floor((whole - 1) / size))
    parts = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), cut))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    cut_up = rows.select("doc_id", whole.alias("whole"), "row", parts.alias("p"))
    return cut_up.select("doc_id", "p.text", "whole", "row", "p.piece")


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """A document from its pieces: a removed run that goes on in the next one is one."""
    pdf = pdf.sort_values("piece")
    edges = pdf["edges"].to_numpy()
    joined = int(np.count_nonzero((edges[:-1] >= 2) & (edges[1:] % 2 == 1)))
    one = pdf.iloc[:1][["doc_id", "n_bytes"]]
    return one.assign(n_removed=pdf["n_removed"].sum(), n_spans=pdf["n_spans"].sum() - joined, kept=[b"".join(pdf["kept"])])


def remove_repeats(
    docs: DataFrame, crowded: int = CROWDED, batch_text: int = BATCH_TEXT, bucket_text: int = BUCKET_TEXT, piece: int = PIECE
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs), kept (remaining bytes) for
    each row of ``docs``."""
    size = F.octet_length("text")
    total, longest = (v or 0 for v in docs.agg(F.sum(size), F.max(size)).first())
    n_batches, n_buckets = max(1, math.ceil(total / batch_text)), max(1, math.ceil(total / bucket_text))
    rows = pieces(docs.select("doc_id", "text"), piece, longest > piece)
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)))
    texts = rows.select("doc_id", "text", "batch")
    packed = "bucket long, batch long, data binary"
    keys = texts.groupBy("batch").applyInPandas(_keys_of(n_buckets), packed + ", several binary")
    shared = written(keys.groupBy("bucket").applyInPandas(_shared_of(crowded), "batch long, bucket long, data binary"), "shared-keys")
    sent = texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(_contexts_of(n_buckets), packed)
    owners = written(sent.groupBy("bucket").applyInPandas(_owners, "batch long, bucket long, data binary"), "owners")
    back = shared.unionByName(owners)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    made = rows.groupBy("batch").cogroup(back.groupBy("batch")).applyInPandas(_cut_of(n_buckets, piece), out + ", row long, piece long, edges int")
    columns = [c.split()[0] for c in out.split(", ")]
    if longest <= piece:
        return made.select(*columns)
    made = written(made, "cut-pieces")
    long = made.where(F.col("n_bytes") > piece).groupBy("row").applyInPandas(_together, out)
    return made.where(F.col("n_bytes") <= piece).select(*columns).unionByName(long)
