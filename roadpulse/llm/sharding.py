"""Sharding by fixed virtual slots.

Every row hashes into one of ``SLOTS`` virtual slots for good. A versioned map
assigns slots to shards; rows never move by themselves, slots do. Version 1
deals the slots out in turn; ``rebalance`` looks at the bytes of each slot and
makes the next version by moving single slots from the fullest shard to the
emptiest until no move helps; ``grow`` adds a shard by moving slots into it only.
A run over a table whose map is stored starts from the newest version, so a row
changes its shard only where a slot is moved, and stores a version if it moves any.
The map has ``SLOTS`` rows whatever the table holds, so it is edited on the
driver and broadcast.

A row's place in its shard: rows before its slot in the shard, plus its rank in
the slot. Only one slot's rows (``1/SLOTS`` of the table) are ranked together.

Edge cases: a null text has no bytes (size 8, CRC 0). A null ``doc_id`` hashes by
the text instead. Rows that repeat a ``doc_id`` share a slot and get a place
each. An empty table gives no rows. An output column replaces an input column
of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.files import entries

SLOTS, SHARDS = 4096, 24
ROW_BYTES = 8

SlotMap = dict[int, int]


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    return {s: s % shards for s in range(slots)}


def rebalance(current: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """The next version: slots move from the fullest shard to the emptiest, each
    time the slot that evens the two out best, until none narrows the gap."""
    new = dict(current)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in new.items():
        if sizes.get(slot, 0):
            held[shard][slot] = sizes[slot]
    load = [sum(h.values()) for h in held]
    while True:
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [(abs(gap - 2 * size), slot) for slot, size in held[high].items() if size < gap]
        if not fits:
            return new
        slot = min(fits)[1]
        size = held[high].pop(slot)
        held[low][slot] = size
        load[high] -= size
        load[low] += size
        new[slot] = low


def grow(current: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """The next version with one more shard (number ``shards``): slots move into
    it only, from the fullest shards, while that leaves it no fuller than they."""
    new = dict(current)
    load = [0] * (shards + 1)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in new.items():
        load[shard] += sizes.get(slot, 0)
        held[shard].append((sizes.get(slot, 0), slot))
    while True:
        high = max(range(shards), key=load.__getitem__)
        fits = [(size, slot) for size, slot in held[high] if size and load[shards] + size <= load[high] - size]
        if not fits:
            return new
        size, slot = max(fits)
        held[high].remove((size, slot))
        load[high] -= size
        load[shards] += size
        new[slot] = shards


def save_map(spark, slot_map: SlotMap, version: int, path: str) -> None:
    """Add a version to the stored map; a version, once there, is never changed."""
    rows = spark.createDataFrame([(version, s, d) for s, d in sorted(slot_map.items())], "version int, vslot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark, path: str, version: int) -> SlotMap:
    return {r["vslot"]: r["shard"] for r in spark.read.parquet(f"{path}/version={version}").collect()}


def _versions(spark, path: str) -> list[int]:
    """Numbers of the versions begun, newest first."""
    named = [e.name for e in entries(spark, path) if e.is_dir and e.name.startswith("version=")]
    return sorted((int(name.split("=")[1]) for name in named), reverse=True)


def newest_version(spark, path: str) -> int:
    """The newest version that has its (one) file, so not one whose writing was cut
    off; 0: none."""
    for v in _versions(spark, path):
        if any(e.name.startswith("part-") for e in entries(spark, f"{path}/version={v}")):
            return v
    return 0


def map_folder(spark, sf_dir: str, name: str) -> str:
    """Where the query ``name`` keeps the map of the tables in ``sf_dir``: under the
    shared checkpoint folder itself, not the session's own folder in it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    table = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/slot-maps/{name}-{table}"


def next_map(spark, sizes: dict[int, int], shards: int, slots: int, path: str | None) -> SlotMap:
    """The newest stored map, rebalanced; stored as the next version if it differs."""
    version = newest_version(spark, path) if path else 0
    last = max(_versions(spark, path), default=0) if path else 0
    if version:
        stored = load_map(spark, path, version)
        have = max(stored.values()) + 1
        if len(stored) != slots or have > shards:
            raise ValueError(f"{path} maps {len(stored)} slots to {have} shards, not {slots} to at most {shards}")
    else:
        stored, have = first_map(shards, slots), shards
        if path:
            last += 1
            save_map(spark, stored, last, path)
    made = stored
    for k in range(have, shards):
        made = grow(made, sizes, k)
    made = rebalance(made, sizes, shards)
    if path and made != stored:
        save_map(spark, made, last + 1, path)
    return made


def vslot(slots: int = SLOTS):
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    return F.pmod(key, F.lit(slots)).cast("int")


def row_size():
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot (at most ``slots`` rows)."""
    made = docs.select(vslot(slots).alias("v"), row_size().alias("b")).groupBy("v").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["v"]: (r["b"], r["n"]) for r in made.collect()}


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard, slot (its place in
    the shard, gapless from 0) and grown_shard (null under this law).

    With ``map_path``, the map is kept there: the newest version is where this run
    starts from, and what it makes of it is stored as the next.
    """
    spark = docs.sparkSession
    stats = slot_sizes(docs, slots)
    sizes = {v: b for v, (b, _) in stats.items()}
    slot_map = next_map(spark, sizes, shards, slots, map_path)
    base, rows = {}, [0] * shards
    for v in range(slots):
        base[v] = rows[slot_map[v]]
        rows[slot_map[v]] += stats.get(v, (0, 0))[1]
    places = spark.createDataFrame([(v, slot_map[v], base[v]) for v in range(slots)], "__vslot int, __shard int, __base long")
    own = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    plain = [c for c in docs.columns if c.lower() not in own]
    made = docs.select(
        *plain,
        row_size().alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        vslot(slots).alias("__vslot"),
    )
    rank = F.row_number().over(Window.partitionBy("__vslot").orderBy("doc_id", "text_crc32", "size"))
    made = made.withColumn("__rank", rank).join(F.broadcast(places), "__vslot")
    return made.select(
        *plain,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__base") + F.col("__rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
