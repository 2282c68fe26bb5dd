"""Benchmark decontamination by spaced-seed hashing.

Texts become words (lower-cased runs of ASCII letters, digits, ``_`` and
non-ASCII characters). A seed is the hash of the words under the ones of a fixed
mask; the zeros are passed over, so a changed word between them does not hide a
match. Each length of item up to ``WINDOW`` words has its masks, of five words from
six on, of the words that must agree below; together they meet every window of that
length with at most a fifth of its words substituted (tests/llm enumerates them).

Seeds of the benchmark and of the documents are joined. A bit table of the benchmark's
seeds (``TABLE_BITS`` bits for each, between fixed limits) goes to every task first and
leaves document seeds out that have no partner. Copied passages and repeated items are
folded before the join: what is joined are the distinct *places* of either side, a seed
and the words around it. A pair of places is verified on those words: an overlap is an
aligned window of ``WINDOW`` words (the whole item, if shorter) in which at least
``SIMILAR`` of the words agree.

Places are paired only where one side has at most ``NARROW`` of them for a key, so pairs
grow with the places, not with their product. Where both sides have more (a phrase that
many documents and many items use), the key is narrowed: with the seed's words fixed in a
window, the words left are cut into one group more than may differ, so two places that
overlap agree in one whole group; each place gets a longer key for each group. Keys
that only one side has drop out, and crowded ones are narrowed again until the words
of the key alone are enough for an overlap: then sharing the key is the proof, and nobody
is paired.

Items come out in classes: a class is a set of items that some place or key stands for,
and sets of the same items are one class. A document has the ids of its classes;
``overlaps_of`` also returns the table of each class's items. So documents and items that
all overlap each other cost their sum, not their product.

Edge cases: null and empty texts on either side match nothing; so do items
without words. An item of fewer than five words has to occur as it is; one of a
single word is found wherever that word is. Repeated items and
repeated rows are judged like any other; items with a null ``item_id`` are one item of
their classes. Rows with a null ``doc_id`` are judged by their text. Empty tables are fine on
either side. Other columns are not read (``clean`` returns them).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, text_key, tokens, written

WINDOW, SIMILAR = 15, 0.8
_LONG = ("1110101", "1101011", "110111")
# Masks of the items of each length (``WINDOW``: of that length or longer).
MASKS_OF = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "10111", "11011", "11101"),
    6: ("11111", "101111", "110111", "111011", "111101"),
    7: (*_LONG, "11111"),
    8: _LONG,
    9: _LONG,
    10: (*_LONG, "11111", "1110011"),
    11: (*_LONG, "11111"),
    12: (*_LONG, "11111"),
    13: _LONG,
    14: _LONG,
    15: _LONG,
}
MASKS = tuple(dict.fromkeys(m for size in sorted(MASKS_OF, reverse=True) for m in MASKS_OF[size]))
SPAN = min(MASKS_OF)  # words of the shortest items that are searched
# Words kept on the left of a seed's first word, and from it on.
LEFT, RIGHT = max(size - len(m) for size, masks in MASKS_OF.items() for m in masks), WINDOW
# Bit table: bits for each seed of the benchmark, and its least and largest size (8 MB).
TABLE_BITS, LEAST_BITS, MOST_BITS, PROBES = 16, 1 << 22, 1 << 26, 3
# Places of the rarer side of a key that are paired with the other side's.
NARROW = 16


@dataclass(frozen=True)
class State:
    """Words of a window of ``size`` that a key holds; the window begins ``start`` words
    before the seed."""

    size: int
    start: int
    words: tuple[int, ...]

    @property
    def proof(self) -> bool:
        """Whether places that agree in these words overlap in any case."""
        return self.size - len(self.words) <= self.size // 5

    def narrowed(self) -> list[State]:
        """One state more than words may differ: an overlap has one of them."""
        left = [k for k in range(self.size) if k not in self.words]
        groups = np.array_split(left, self.size // 5 + 1)
        return [replace(self, words=tuple(sorted({*self.words, *map(int, g)}))) for g in groups]

    def number(self) -> int:
        """Tells states apart in one number."""
        return (sum(1 << k for k in self.words) << 8) + (self.size << 4) + self.start


def first_states(mask: str, size: int) -> list[State]:
    """Where a seed can lie in a window."""
    ones = [k for k, bit in enumerate(mask) if bit == "1"]
    if mask not in MASKS_OF[size]:
        return []
    return [State(size, a, tuple(a + k for k in ones)) for a in range(size - len(mask) + 1)]


def state_of(number: int) -> State:
    words = number >> 8
    return State(number >> 4 & 15, number & 15, tuple(k for k in range(WINDOW) if words >> k & 1))


def keys(place: np.ndarray, states: list[State]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, state number and key of each window that lies in the text, for the word
    hashes around the seeds."""
    rows, numbers, out = [], [], []
    for state in states:
        window = place[:, LEFT - state.start : LEFT - state.start + state.size]
        inside = np.flatnonzero((window != 0).all(axis=1))
        key = np.full(len(inside), state.number(), dtype=np.uint64)
        for k in state.words:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + window[inside, k].astype(np.uint64))
        rows.append(inside)
        numbers.append(np.full(len(inside), state.number()))
        out.append(key.view(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, numbers, out))


def seeds(h: np.ndarray, of: np.ndarray, sizes, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of tokenised texts: (index of the first word, seed, mask), by the masks of
    items of ``sizes`` words; with ``length`` (words of each text, ``WINDOW`` at most),
    a text's seeds are by the masks of its own length only."""
    at, out, by = [], [], []
    for m, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        use = [size for size in sizes if mask in MASKS_OF[size]]
        if n <= 0 or not use:
            continue
        ok = of[:n] == of[len(mask) - 1 :]
        if length is not None:
            ok &= np.isin(length, use)[of[:n]]
        ok = np.flatnonzero(ok)
        seed = np.full(len(ok), m + 1, dtype=np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                seed = seed * np.uint64(0x9E3779B97F4A7C15) + h[ok + k]
        at.append(ok)
        out.append(mix64(seed))
        by.append(np.full(len(ok), m, dtype=np.int32))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(at), np.concatenate(out), np.concatenate(by)


def around(h: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32-bit word hashes around each seed, 0 outside its text."""
    idx = at[:, None] + np.arange(-LEFT, RIGHT)
    inside = (idx >= 0) & (idx < len(h))
    idx = np.where(inside, idx, 0)
    inside &= of[idx] == of[at][:, None]
    return np.where(inside, (h[idx] >> np.uint64(32)).astype(np.uint32) | 1, 0).astype("<u4")


def probes(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a seed in a table of ``bits`` bits."""
    mask = np.uint64(bits - 1)
    return [(seed >> np.uint64(21 * k)) & mask for k in range(PROBES)]


def overlaps(doc: np.ndarray, item: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether an aligned window around the hit agrees well enough. ``doc`` and
    ``item``: word hashes around the seeds; ``length``: words of the items."""
    same, there = doc == item, item != 0
    same = np.cumsum(np.pad(same & there, ((0, 0), (1, 0))), axis=1)
    there = np.cumsum(np.pad(there, ((0, 0), (1, 0))), axis=1)
    found = np.zeros(len(doc), dtype=bool)
    for size in np.unique(np.minimum(length, WINDOW)):
        rows = np.flatnonzero(np.minimum(length, WINDOW) == size)
        full = there[rows][:, size:] - there[rows][:, :-size] == size
        agree = same[rows][:, size:] - same[rows][:, :-size]
        found[rows] = (full & (agree >= SIMILAR * size - 1e-9)).any(axis=1)
    return found


def _lower(texts) -> list[str | None]:
    return [None if t is None else t.lower() for t in texts]


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, mask, item_id, size (words, ``WINDOW`` at most), around: every seed of every
    item."""

    def made(batches):
        for pdf in batches:
            for first, run in blocks(_lower(pdf["text"])):
                h, of = tokens(run)
                size = np.minimum(np.bincount(of, minlength=len(run)), WINDOW)
                at, seed, mask = seeds(h, of, MASKS_OF, size)
                yield pd.DataFrame(
                    {
                        "seed": seed.view(np.int64),
                        "mask": mask,
                        "item_id": pdf["item_id"].iloc[first + of[at]].to_numpy(),
                        "size": size[of[at]],
                        "around": [r.tobytes() for r in around(h, of, at)],
                    }
                )

    schema = "seed long, mask int, item_id long, size int, around binary"
    return benchmark.select(F.col("item_id").cast("long"), "text").mapInPandas(made, schema)


def bit_table(items: DataFrame) -> np.ndarray:
    """The bit table: at most ``MOST_BITS / 64`` words reach the driver."""
    n = items.select("seed").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, TABLE_BITS * n - 1).bit_length()))
    at = F.explode(F.array(*[F.expr(f"shiftrightunsigned(seed, {21 * k}) & {bits - 1}L") for k in range(PROBES)]))
    words = items.select(at.alias("p")).groupBy(F.expr("p div 64").alias("w"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toPandas()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[found["w"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def item_sizes(items: DataFrame) -> list[int]:
    """Lengths of the items, ``WINDOW`` at most: those whose masks are needed."""
    return sorted(r[0] for r in items.select("size").distinct().collect())


def document_seeds(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, tkey, seed, mask, around: the documents' seeds, by the masks of items of
    ``sizes`` words, that the table holds."""
    packed = np.packbits(table).tobytes()

    def made(batches):
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        for pdf in batches:
            for first, run in blocks(_lower(pdf["text"])):
                h, of = tokens(run)
                at, seed, mask = seeds(h, of, sizes)
                for p in range(PROBES):
                    hit = bits[probes(seed, len(bits))[p]]
                    at, seed, mask = at[hit], seed[hit], mask[hit]
                if len(at):
                    rows = first + of[at]
                    yield pd.DataFrame(
                        {
                            "doc_id": pdf["doc_id"].iloc[rows].to_numpy(),
                            "tkey": pdf["tkey"].iloc[rows].to_numpy(),
                            "seed": seed.view(np.int64),
                            "mask": mask,
                            "around": [r.tobytes() for r in around(h, of, at)],
                        }
                    )

    schema = "doc_id long, tkey long, seed long, mask int, around binary"
    return docs.select("doc_id", text_key().alias("tkey"), "text").mapInPandas(made, schema)


def _verify(doc: pd.Series, item: pd.Series, length: pd.Series) -> pd.Series:
    width = LEFT + RIGHT
    both = [np.frombuffer(b"".join(s), dtype="<u4").reshape(-1, width) for s in (doc, item)]
    return pd.Series(overlaps(*both, length.to_numpy()))


def places(rows: DataFrame, *more: str) -> DataFrame:
    """Distinct places with a number each."""
    return rows.select("seed", "mask", "around", *more).distinct().withColumn("place", F.monotonically_increasing_id())


def _first_keys(rows: DataFrame) -> DataFrame:
    """place, state, key of places (with the size of the window) by the groups that an
    overlap around the seed must agree in."""

    def made(batches):
        for pdf in batches:
            for (m, size), part in pdf.groupby(["mask", "size"]):
                states = [n for s in first_states(MASKS[m], size) for n in ([s] if s.proof else s.narrowed())]
                yield _keyed(part, states)

    return rows.select("place", "mask", "size", "around").mapInPandas(made, "place long, state long, key long, around binary")


def _next_keys(rows: DataFrame) -> DataFrame:
    """The same for places whose keys are to be narrowed."""

    def made(batches):
        for pdf in batches:
            for state, part in pdf.groupby("state"):
                yield _keyed(part, state_of(state).narrowed())

    return rows.select("place", "state", "around").mapInPandas(made, "place long, state long, key long, around binary")


def _keyed(part: pd.DataFrame, states: list[State]) -> pd.DataFrame:
    words = np.frombuffer(b"".join(part["around"]), dtype="<u4").reshape(len(part), LEFT + RIGHT)
    row, state, key = keys(words, states)
    of = part.iloc[row]
    return pd.DataFrame({"place": of["place"].to_numpy(), "state": state, "key": key, "around": of["around"].to_numpy()})


def shared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """key, crowded: the keys that both sides have."""
    a = ours.groupBy("key").agg(F.count(F.lit(1)).alias("a"))
    b = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "key").select("key", (F.least("a", "b") > NARROW).alias("crowded"))


def paired(ours: DataFrame, theirs: DataFrame, light: DataFrame) -> DataFrame:
    """Pairs of places of the keys in ``light``: at most ``NARROW`` times as many as places
    (a key narrowed in several ways can pair the same two again)."""
    a = ours.join(light, "key").select("key", F.col("place").alias("ours"), F.col("around").alias("doc_around"))
    return a.join(theirs.select("key", F.col("place").alias("theirs"), "around", "size"), "key")


def matches(docs: DataFrame, items: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of the places of documents and items: pairs (ours, theirs) that overlap, and (ours,
    key) with (theirs, key) where the key is the proof; the last two as one frame with
    the side."""
    verify = F.pandas_udf(_verify, "boolean")
    pairs, proofs = [], []
    state = F.lit(None).cast("long").alias("state")
    ours = docs.select("place", "mask", state, F.col("seed").alias("key"), "around")
    theirs = items.select("place", "mask", "size", state, F.col("seed").alias("key"), "around")
    sizes = items.select("place", "size")
    for level in range(WINDOW):
        known = written(shared(ours, theirs), "decontam-keys")
        found = paired(ours, theirs, known.where(~F.col("crowded")).select("key"))
        pairs.append(written(found.where(verify("doc_around", "around", "size")).select("ours", "theirs").distinct(), "decontam-pairs"))
        crowded = known.where("crowded").select("key")
        if crowded.isEmpty():
            break
        ours, theirs = ours.join(crowded, "key", "left_semi"), theirs.join(crowded, "key", "left_semi")
        if level == 0:
            # A document's place is narrowed for the sizes of the items it may meet.
            of_key = theirs.select("key", "size").distinct()
            ours = _first_keys(ours.join(of_key, "key"))
            theirs = _first_keys(theirs)
        else:
            ours, theirs = _next_keys(ours), _next_keys(theirs)
        ours = written(ours, "decontam-ours")
        theirs = written(theirs.join(sizes, "place"), "decontam-theirs")
        proof = F.udf(lambda n: state_of(n).proof, "boolean")
        states = written(theirs.select("state").distinct().withColumn("proof", proof("state")), "decontam-states")
        ended = states.where("proof").select("state")
        open_ = states.where("not proof").select("state")
        both = theirs.join(ended, "state").select("key").distinct()
        for side, rows in (("ours", ours), ("theirs", theirs)):
            proofs.append(rows.join(both, "key", "left_semi").select("place", "key").distinct().withColumn("side", F.lit(side)))
        ours, theirs = ours.join(open_, "state", "left_semi"), theirs.join(open_, "state", "left_semi")
    return pairs, proofs


def overlaps_of(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, tkey (key of the text), class_ids of the documents that overlap an item,
    and class_id, item_id of the classes' items."""
    made = written(item_seeds(benchmark), "item-seeds")
    hits = written(document_seeds(docs, bit_table(made), item_sizes(made)), "document-seeds")
    ours, theirs = written(places(hits), "document-places"), written(places(made, "size"), "item-places")
    pairs, proofs = matches(ours, theirs)
    # A group is what a place of an item, or a key that is a proof, stands for.
    met = [p.select(F.col("ours").alias("place"), F.xxhash64(F.lit("place"), "theirs").alias("group")) for p in pairs]
    own = [p.select(F.col("theirs").alias("place"), F.xxhash64(F.lit("place"), "theirs").alias("group")) for p in pairs]
    for p in proofs:
        group = p.select("side", "place", F.xxhash64(F.lit("key"), "key").alias("group"))
        met.append(group.where("side = 'ours'").drop("side"))
        own.append(group.where("side = 'theirs'").drop("side"))
    met, own = (written(_union(x).distinct(), "decontam-groups") for x in (met, own))
    at = theirs.select("place", "seed", "size", "around")
    items = own.join(at, "place").join(made, ["seed", "size", "around"]).select("group", "item_id").distinct()
    items = written(items, "decontam-items")
    # Groups of the same items are one class: its id is a hash of their set.
    sets = items.groupBy("group").agg(
        F.xxhash64(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(F.lit(k), "item_id")) for k in (1, 2)]).alias("class_id")
    )
    sets = written(sets, "decontam-classes")
    one = sets.groupBy("class_id").agg(F.min("group").alias("group"))
    table = one.join(items, "group").select("class_id", "item_id")
    of_place = met.join(sets, "group").select("place", "class_id").distinct().join(ours.select("place", "seed", "around"), "place")
    each = hits.join(of_place, ["seed", "around"]).groupBy("doc_id", "tkey")
    return each.agg(F.array_sort(F.collect_set("class_id")).alias("class_ids")), table


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_classes, class_ids for each row of ``docs``."""
    bad = written(overlaps_of(docs, benchmark)[0], "contaminated")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key"), "class_ids")
    rows = docs.select("doc_id", text_key().alias("tkey"))
    cond = rows["doc_id"].eqNullSafe(bad["__id"]) & (rows["tkey"] == bad["__key"])
    return rows.join(bad, cond, "left").select(
        "doc_id",
        F.col("__key").isNotNull().alias("contaminated"),
        F.coalesce(F.size("class_ids"), F.lit(0)).cast("long").alias("n_classes"),
        F.coalesce("class_ids", F.array().cast("array<long>")).alias("class_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item."""
    bad = written(overlaps_of(docs, benchmark)[0], "contaminated")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (text_key() == bad["__key"]), "left_anti")
