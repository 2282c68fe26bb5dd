"""Prefix trie of conversations, as a table of nodes in minimal-perfect-hash slots.

A node is a distinct sequence of first turns (role, text); the conversations that
start with it are its members. Each turn of a conversation gets the digest of the
turns up to it: the exclusive-or of position-keyed hashes, 128 bits wide. Grouping by
depth and digest enumerates the nodes and counts members; a group whose rows differ in
their parent's digest or in a third hash of their last turn is an error.

What is summed over subtrees is summed in shards. In a shard every node has a slot of
a minimal perfect hash (``perfect_hash``), its counts are scattered into flat arrays by
slot, and the arrays are added up through the array of parent slots, deepest nodes
first. The digest stored in a slot is compared with the one asked for, so a parent in
another shard is never taken for a node of this one.

A node is *light* if the members' turns at or below it are at most ``LIGHT``, and heavy
otherwise. A light node below a heavy one is the top of a piece, a whole subtree of at
most ``LIGHT`` nodes; pieces are dealt to shards by hash. Their totals, added up for
each parent before the shuffle, enter the heavy nodes, of which a level has at most the
table's rows / ``LIGHT``. These go in bands of levels of at most ``BAND`` nodes, the
deepest first (a level of more is dealt to several shards), each passing its totals on.
So no task holds more than a shard, whatever a first turn or a conversation is shared by.

A conversation of any length is numbered and hashed in parts: rows are sorted in ranges
over all partitions, a range's counts give where the next one starts, and digests are
taken within blocks of ``BLOCK`` turns and over blocks.

``ends_sha256`` hashes the numbers of the conversations that end at a node, in order. They
are put into text in parts of 2^``PART_BITS`` numbers; a node with several parts is
hashed by one task as its parts stream by, since this hash has no other order.

Edge cases: turns are ordered by turn (null first), then role and text; repeated rows are
turns of their own. A null role or text is empty. Rows without a ``conv_id`` belong to no
conversation and make no node. An empty table gives no rows. Only ``conv_id``, ``turn``,
``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, running_xor, written
from .perfect_hash import Slots

LIGHT, SHARD, BAND = 100_000, 200_000, 500_000
BLOCK = 4096
PART_BITS = 16

KEY = ["depth", "h1", "h2"]
_WORDS = "[^\\x20\\x09-\\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, nth (from 0), t1, t2, t3 (hashes of role and text), words, n (turns of
    the conversation): every turn at its place."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2, 3)]
    words = F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words")
    return numbered(rows, "conv_id", ["turn", "role", "text"], [*hashes, words], "trie-turns")


def borrowed(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a shared start: with h the CRC-32 of the decimal
    ``conv_id`` modulo ``most``, the first h turns come from the group's first
    conversation (``conv_id`` minus its remainder by ``group``, which has the sign of
    ``conv_id``; all it has if fewer, none
    if there is none), then the conversation's own turns after its first h.

    Returns (conv_id, n) of all conversations and the rebuilt turns."""
    donor = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.where("nth = 0").select("conv_id", donor.alias("donor"), h.alias("h"), "n")
    given = convs.where("conv_id = donor").select("donor", F.col("n").alias("has"))
    took = F.least("h", F.coalesce("has", F.lit(0)))
    convs = convs.join(given, "donor", "left").select(
        "conv_id", "donor", "h", took.alias("took"), (took + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n")
    )
    convs = written(convs, "trie-conversations")
    value = ["t1", "t2", "t3", "words"]
    theirs = turns.where(f"nth < {most - 1}").where(F.col("conv_id") == donor).select(F.col("conv_id").alias("donor"), "nth", *value)
    start = convs.select("conv_id", "donor", "took", "n").join(theirs, "donor").where("nth < took")
    rest = turns.drop("n").join(convs, "conv_id").where("nth >= h").withColumn("nth", F.col("nth") - F.col("h") + F.col("took"))
    names = ["conv_id", "nth", *value, "n"]
    return convs.select("conv_id", "n"), start.select(*names).unionByName(rest.select(*names))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n, depth, h1, h2 (digest of the turns up to this one), p1, p2 (up to
    the one before), t3, words."""
    keyed = turns.withColumns({f"g{k}": F.xxhash64(F.lit(k), "nth", "t1", "t2") for k in (1, 2)})
    made = running_xor(keyed, "conv_id", ["g1", "g2"], block)
    return made.select(
        "conv_id",
        "n",
        (F.col("nth") + 1).alias("depth"),
        *[F.col(f"g{k}_so_far").alias(f"h{k}") for k in (1, 2)],
        *[F.col(f"g{k}_so_far").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (1, 2)],
        "t3",
        "words",
    )


def enumerated(rows: DataFrame) -> DataFrame:
    """One row for each node: its key, parent's digest, members, the words of its last
    turn, the conversations that end there, and the turns at or below it."""
    same = F.lit(True)
    for c in ("p1", "p2", "t3"):
        same = same & (F.min(c) == F.max(c))
    ends = F.col("depth") == F.col("n")
    return rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.when(same, F.max("words")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long")).alias("words"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.sum(ends.cast("long")).alias("n_ends"),
        F.coalesce(F.min(F.when(ends, F.col("conv_id"))), F.lit(0)).alias("one_end"),
        F.sum(F.col("n") - F.col("depth") + 1).alias("turns_below"),
    )


_IN = [*KEY, "p1", "p2", "conv_id", "above", "n_convs", "words", "n_ends", "one_end", "children", "leaves", "saved"]
_OUT = [*KEY, "p1", "p2", "edge", "conv_id", "parent_conv_id", "n_convs", "n_ends", "one_end", "n_children", "n_leaves", "saved_tokens"]
_OUT_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'edge' else 'long'}" for c in _OUT)


def accumulate(shard: pa.Table) -> pa.Table:
    """Sums over subtrees of a shard's nodes. ``children``, ``leaves`` and ``saved`` bring
    what nodes of other shards below have; a node whose parent lies elsewhere is an
    ``edge``."""
    at = {c: shard.column(c).to_numpy() for c in _IN}
    slots = Slots(at["depth"], at["h1"], at["h2"])
    order = np.argsort(slots.slot)  # row of each slot
    flat = {c: at[c][order] for c in _IN}
    depth = flat["depth"]
    parent = slots.find(depth - 1, flat["p1"], flat["p2"])
    parent[depth == 0] = -1
    inside = parent >= 0
    children = flat["children"].copy()
    np.add.at(children, parent[inside], 1)
    leaves = np.where(children == 0, 1, flat["leaves"])
    saved = flat["saved"] + (flat["n_convs"] - 1) * flat["words"]
    by_depth = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, edges)[::-1]:
        up = level[inside[level]]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    above = np.where(inside, flat["conv_id"][parent], flat["above"])
    made = {**flat, "edge": ~inside, "parent_conv_id": above, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    return pa.table({c: made[c] for c in _OUT})


def _solved(nodes: DataFrame, shard: Column, name: str) -> DataFrame:
    given = nodes.select(*_IN, shard.alias("shard"))
    return written(given.groupBy("shard").applyInArrow(lambda t: accumulate(t), _OUT_SCHEMA), name)


def _totals(solved: DataFrame) -> DataFrame:
    """What the edges of solved shards bring to their parents."""
    return (
        solved.where("edge and depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    )


def _dealt(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(max(1, n)))


def subtrees(rows: DataFrame, nodes: DataFrame, light: int = LIGHT, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """Every node with its children, leaves and saved words; ``rows`` are the prefixes
    of all conversations, ``nodes`` what ``enumerated`` makes of them (both written)."""
    is_heavy = (F.col("turns_below") > light) | (F.col("depth") == 0)
    heavy = nodes.where(is_heavy)
    tops = heavy.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("above"))
    # Weights fall along a path: the deepest turn under a heavy node is the top of the
    # piece that holds the light rest of the conversation (if it has one).
    under = rows.join(tops, ["depth", "p1", "p2"]).groupBy("conv_id").agg(F.max(F.struct("depth", "h1", "h2", "above")).alias("top"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    pieces = nodes.where(~is_heavy).join(under, "conv_id").select("*", "top.above", F.xxhash64("top.depth", "top.h1", "top.h2").alias("piece"), *nothing)
    n_light = nodes.where(~is_heavy).count()
    done = [_solved(pieces, _dealt(["piece"], -(-n_light // shard)), "trie-light")]
    levels = heavy.groupBy("depth").count().agg(F.max("count"), F.max("depth")).first()
    if levels[0] is None:
        return done[0]
    per = max(1, band // levels[0])
    brought = _totals(done[0])
    heavy = heavy.join(tops, ["depth", "p1", "p2"], "left").withColumn("above", F.coalesce("above", F.lit(0)))
    for b in range(levels[1] // per, -1, -1):
        own = F.col("depth").between(b * per, (b + 1) * per - 1)
        sums = brought.where(own).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
        nodes_of = heavy.where(own).join(sums, KEY, "left").fillna(0, ["children", "leaves", "saved"])
        done.append(_solved(nodes_of, _dealt(KEY, -(-levels[0] // band) if per == 1 else 1), "trie-heavy"))
        brought = _totals(done[0]).unionByName(_totals(done[-1]))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def end_hashes(rows: DataFrame, bits: int = PART_BITS) -> DataFrame:
    """depth, h1, h2, ends_sha256 of the nodes where several conversations end."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    parts = rows.where("depth = n").groupBy(*KEY, F.shiftright("conv_id", bits).alias("part"))
    parts = written(parts.agg(F.array_join(ids, ",").alias("ids"), F.count(F.lit(1)).alias("size")), "trie-ends")
    of = parts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.min("ids").alias("ids")).where("size > 1")
    short = of.where("parts = 1").select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = parts.join(of.where("parts > 1").select(*KEY), KEY).select(*KEY, "part", "ids")
    streamed = many.repartition(*KEY).sortWithinPartitions(*KEY, "part")
    return short.unionByName(streamed.mapInArrow(_streamed, "depth long, h1 long, h2 long, ends_sha256 string"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the parts of each node, which come one after the other."""

    def row(key, state):
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key), ends_sha256=state.hexdigest())])

    key, state = None, None
    for batch in batches:
        for *own, ids in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("ids")):
            if own != key:
                if key is not None:
                    yield row(key, state)
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if key is not None:
        yield row(key, state)


def prefix_trie(
    conversations: DataFrame,
    group: int | None = None,
    most: int = 4,
    light: int = LIGHT,
    shard: int = SHARD,
    band: int = BAND,
    block: int = BLOCK,
    bits: int = PART_BITS,
) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 for every node. With ``group``, of the conversations that
    ``borrowed`` rebuilds."""
    turns = written(turns_of(conversations), "trie-numbered")
    if group is None:
        convs = turns.where("nth = 0").select("conv_id", "n")
    else:
        convs, turns = borrowed(turns, group, most)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "n", *[zero.alias(c) for c in ("depth", "h1", "h2", "p1", "p2", "t3", "words")])
    rows = written(prefixes(turns, block).unionByName(root), "trie-prefixes")
    nodes = written(enumerated(rows), "trie-nodes")
    made = subtrees(rows, nodes, light, shard, band)
    several = made.where("n_ends > 1").join(end_hashes(rows, bits), KEY)
    one = F.when(F.col("n_ends") == 1, F.col("one_end").cast("string")).otherwise("")
    others = made.where("n_ends < 2").withColumn("ends_sha256", F.sha2(one.cast("binary"), 256))
    return several.unionByName(others).select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )
