"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint has 64 bits; documents whose fingerprints differ in at most
``max_bits`` bits are linked, and a group is a connected component.

The trie of the distinct fingerprints is cut at a depth that grows with their
number, so that one subtree holds about ``SUBTREE`` of them. Two subtrees meet
only when their prefixes differ in at most ``max_bits`` bits; each such pair of
subtrees is one group of rows, and the pair is walked together inside a task
(``linked``): node pairs step down one bit at a time, differing bits add up, and
a pair of nodes is dropped once they exceed the budget. A pair of subtrees
holding far more fingerprints than usual is cut deeper before it is walked, so
no task gets an unbounded group. A walk returns links that connect what it
found connected (a forest), not every pair; node pairs already connected are
passed over.

Edge cases: null and empty texts, and texts of white space only, have the
fingerprint 0 and link like any other. Rows with a null ``doc_id`` take part; a
group's id is its smallest non-null ``doc_id`` (null when it has none). Repeated
rows share a fingerprint. An empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, text_key, written
from .components import connected

SHINGLE = 3
MAX_BITS = 2
SEED = 42
# Distinct fingerprints of a subtree at the cut, and how many times that a pair
# of subtrees may hold before it is cut deeper.
SUBTREE, CROWDED = 4096, 64
# Bits of each deeper cut.
DEEPER = 6
# Node pairs walked at once, and leaf pairs compared directly.
FRONTIER, LEAF = 1 << 17, 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the words of ``text`` (A-Z lower-cased, separated by
    ASCII white space), over all ``shingle``-word windows, repeats included."""
    words = encode(text).lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    hist = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, 1 << 15):  # long texts piece by piece
        some = starts[at : min(at + (1 << 15), n)]
        ends = starts[at + min(shingle, len(words)) :]
        raw = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(some, ends)])
        lanes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8) + _LANES
        hist += np.bincount(lanes.ravel(), minlength=2048)
    # The digest is big-endian: byte k holds bits 56-8k upwards.
    ones = (hist.reshape(8, 256) @ _BITS)[::-1].ravel()
    return sum(1 << int(j) for j in np.flatnonzero(2 * ones > n))


def fingerprint_udf(shingle: int = SHINGLE):
    def made(texts: pd.Series) -> pd.Series:
        fps = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(fps.view(np.int64))

    return F.pandas_udf(made, "long")


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the one-child of each node begins; nodes are ranges of sorted ``x``
    sharing the bits above ``bit``."""
    b = np.uint64(bit)
    first = ((x[lo] >> b) | np.uint64(1)) << b
    return np.searchsorted(x, first)


class _Forest:
    """Labels of sorted fingerprints; the smallest index labels a tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.end = np.arange(1, n + 1)  # end of the run of equal labels

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while True:
            x, y = lab[a], lab[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := lab[lab], lab):
                lab[:] = up
        change = np.append(np.flatnonzero(np.diff(lab)) + 1, len(lab))
        self.end = change[np.searchsorted(change, np.arange(len(lab)), side="right")]

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Node pairs whose members are all in one tree already."""
        return (self.end[a0] >= a1) & (self.end[b0] >= b1) & (self.label[a0] == self.label[b0])


def linked(x: np.ndarray, cut: int, depth: int, max_bits: int, same: bool) -> np.ndarray:
    """Label (smallest connected index) of each of the sorted fingerprints ``x``.

    ``x[:cut]`` and ``x[cut:]`` are two subtrees at ``depth``; with ``same``, there is
    one subtree, paired with itself, and ``cut`` is ``len(x)``.
    """
    forest = _Forest(len(x))
    if not len(x) or not same and not 0 < cut < len(x):
        return forest.label
    at = (0, cut, 0, cut) if same else (0, cut, cut, len(x))
    err = 0 if same else int(np.bitwise_count((x[0] ^ x[cut]) >> np.uint64(64 - depth))) if depth else 0
    stack = [(depth, np.array([[*at, err]]))]
    while stack:
        level, pairs = stack.pop()
        a0, a1, b0, b1, err = pairs.T
        open_ = ~forest.joined(a0, a1, b0, b1)
        a0, a1, b0, b1, err = (v[open_] for v in (a0, a1, b0, b1, err))
        few = ((a1 - a0) * (b1 - b0) <= LEAF) | (level == 64)
        if few.any():
            _compare(x, forest, a0[few], a1[few], b0[few], b1[few], max_bits, level == 64)
        a0, a1, b0, b1, err = (v[~few] for v in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        am, bm = _split(x, a0, a1, 63 - level), _split(x, b0, b1, 63 - level)
        self_pair = a0 == b0
        steps = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
        kids = np.concatenate([np.stack(s, 1)[~self_pair | (k < 3)] for k, s in enumerate(steps)])
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= max_bits)]
        for i in range(0, len(kids), FRONTIER):
            stack.append((level + 1, kids[i : i + FRONTIER]))
    return forest.label


def _compare(x, forest, a0, a1, b0, b1, max_bits: int, bottom: bool) -> None:
    """All members of small node pairs against each other. At the bottom of the
    trie a node holds one fingerprint."""
    na, nb = (np.ones_like(a0), np.ones_like(b0)) if bottom else (a1 - a0, b1 - b0)
    each = na * nb
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    width = np.repeat(nb, each)
    i, j = np.repeat(a0, each) + k // width, np.repeat(b0, each) + k % width
    near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= max_bits)
    if near.any():
        forest.link(i[near], j[near])


def _walk(max_bits: int):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        depth, same = int(group["depth"].iat[0]), bool(group["lo"].iat[0] == group["hi"].iat[0])
        x = np.sort(group["fp"].to_numpy(np.int64).view(np.uint64))
        prefix = x >> np.uint64(64 - depth) if depth else np.zeros_like(x)
        cut = len(x) if same else int(np.count_nonzero(prefix == prefix[0]))
        label = linked(x, cut, depth, max_bits, same)
        far = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"a": x[far].view(np.int64), "b": x[label[far]].view(np.int64)})

    return walk


def _masks(bits: int, most: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= most] if bits <= 12 else sorted(
        {sum(1 << i for i in c) for k in range(most + 1) for c in _choose(bits, k)}
    )


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def _pairs(fps: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """Each fingerprint once for each pair of subtrees it belongs to."""
    own = F.expr(f"shiftrightunsigned(fp, {64 - depth})") if depth else F.lit(0).cast("long")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(depth, max_bits)])
    other = own.bitwiseXOR(F.col("m"))
    return fps.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.lit(depth).alias("depth"), F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")
    )


def _deeper(items: DataFrame, limit: int, max_bits: int) -> DataFrame:
    """Cut pairs of subtrees that hold more than ``limit`` fingerprints deeper,
    until none is left."""
    key = ["depth", "lo", "hi"]
    done = None
    while True:
        crowded = written(items.groupBy(key).count().where((F.col("count") > limit) & (F.col("depth") < 64)), "crowded")
        if crowded.isEmpty():
            return items if done is None else done.unionByName(items)
        rest = items.join(crowded.select(key), key, "left_anti").select("fp", *key)
        done = rest if done is None else done.unionByName(rest)
        hot = items.join(crowded.select(key), key, "left_semi")
        step = F.least(F.lit(DEEPER), 64 - F.col("depth"))
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(DEEPER, max_bits)])
        used = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
        hot = hot.select("fp", "depth", "lo", "hi", step.alias("step"), used.alias("used"), F.explode(masks).alias("m"))
        hot = hot.where((F.bit_count("m") + F.col("used") <= max_bits) & (F.col("m") < F.expr("shiftleft(1L, step)")))
        down = F.expr("shiftrightunsigned(fp, 64 - depth - step)")
        across = F.expr("shiftleft(lo ^ hi, step)")
        other = down.bitwiseXOR(across).bitwiseXOR(F.col("m"))
        hot = hot.select("fp", (F.col("depth") + F.col("step")).alias("depth"), F.least(down, other).alias("lo"), F.greatest(down, other).alias("hi"))
        items = written(hot, "deeper")


def links(fps: DataFrame, max_bits: int = MAX_BITS, subtree: int = SUBTREE, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` whose chains of
    steps of at most ``max_bits`` bits meet."""
    n = fps.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / subtree)))
    items = _deeper(_pairs(fps, depth, max_bits), subtree * crowded, max_bits)
    return items.groupBy("depth", "lo", "hi").applyInPandas(_walk(max_bits), "a long, b long").distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tkey (key of the text), fp; one row for each row of ``docs``."""
    return docs.select("doc_id", text_key().alias("tkey"), fingerprint_udf(shingle)("text").alias("fp"))


def groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root (smallest fingerprint reachable) for each distinct ``fp``."""
    fps = written(rows.select("fp").distinct(), "fps")
    roots = connected(written(links(fps, max_bits), "links"))
    joined = fps.join(roots, fps["fp"] == roots["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group) for each row of ``docs``."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    roots = written(groups(rows, max_bits), "roots")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = roots.join(first, "fp")
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = written(roots.join(best, "root").select("fp", "component_id"), "ids")
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest ``doc_id`` (null
    last; then the smallest key of the text). Rows that repeat both, whatever
    their other columns hold, count as one document; one of them stays."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    roots = written(groups(rows, max_bits), "roots")
    one = rows.groupBy("fp", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
    pick = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    first = one.groupBy("fp").agg(F.min(F.struct(pick.alias("p"), "n")).alias("first"))
    best = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("best"))
    kept = written(
        best.select(F.col("best.p.doc_id").alias("__id"), F.col("best.p.tkey").alias("__key"), F.col("best.n").alias("__n")),
        "kept",
    )
    cond = docs["doc_id"].eqNullSafe(kept["__id"]) & (text_key() == kept["__key"])
    if kept.where("__n > 1").isEmpty():
        return docs.join(kept, cond, "left_semi")
    single = docs.join(kept.where("__n = 1"), cond, "left_semi")
    many = docs.join(kept.where("__n > 1"), cond)
    one_of = many.groupBy("__id", "__key").agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(one_of)
