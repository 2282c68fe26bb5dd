"""Chat formatting: collapse cumulative snapshots, then render.

A log often holds a conversation again and again, each time with more turns.
Every turn of a conversation gets the rolling hash of the turns up to it: the
exclusive-or of position-keyed hashes of the turns, 128 bits wide. A conversation whose
whole hash is the hash of a proper prefix of another one is a snapshot of it; an anti join
leaves the maximal ones. Of conversations with the same turns, the smallest ``conv_id``
stays. The others are rendered turn by turn. DataFrame functions only.

Prefix hashes are made distinct before the join, so a first turn that a third of
all conversations share is one row on each side. A conversation of any length is numbered
in ranges, hashed in blocks of ``BLOCK`` turns and rendered in parts of as many, so it is
never one task, array or string; parts count from 0, and only a conversation of more than
``BLOCK`` turns has more than one.

Edge cases: turns are ordered by turn, role and text, so repeated turn numbers and
repeated rows have a defined place. A null role, turn or text is a value of its
own to the hash and is rendered as ``unknown`` (role) or empty (text). A row with a
null ``conv_id`` is a conversation of one turn: rows that lost their number are not put
together. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, running_xor, written

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_ROLE = "unknown"
BLOCK = 4096
_KEY = ["n", "h1", "h2"]


def _hashes(nth: Column) -> list[Column]:
    value = [nth, F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(F.lit(k), *value).alias(f"g{k}") for k in (1, 2)]


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, role, text, nth (0 for the first turn), n (turns of the conversation), h1
    and h2 (hash of the turns up to this one)."""
    named = turns.where("conv_id IS NOT NULL")
    found = numbered(named, "conv_id", ["turn", "role", "text"], ["role", "text"], "chat-turns")
    made = running_xor(found.select("*", *_hashes(F.col("nth"))), "conv_id", ["g1", "g2"], block)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = turns.where("conv_id IS NULL").select("conv_id", "role", "text", zero.alias("nth"), one.alias("n"), *_hashes(zero))
    columns = ["conv_id", "role", "text", "nth", "n"]
    return made.select(*columns, *[F.col(f"g{k}_so_far").alias(f"h{k}") for k in (1, 2)]).unionByName(
        alone.select(*columns, *[F.col(f"g{k}").alias(f"h{k}") for k in (1, 2)])
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """n, h1, h2, conv_id, n_copies of the conversations that no other one extends."""
    whole = hashes.where("nth + 1 = n").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = hashes.where("nth + 1 < n").select((F.col("nth") + 1).alias("n"), "h1", "h2").distinct()
    return whole.join(begun, _KEY, "left_anti")


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_copies, part, rendered: one row for each maximal conversation
    (and ``block`` turns of it)."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    hashes = written(prefix_hashes(turns, block), "turn-hashes")
    kept = written(maximal(hashes.drop("role", "text")), "maximal")
    named = kept.where("conv_id IS NOT NULL").select("conv_id", "n_copies", "h1", "h2")
    rows = hashes.drop("h1", "h2").join(named, "conv_id")
    # Conversations that only rows without a number are of: one of their equal turns.
    alone = kept.where("conv_id IS NULL").select(*_KEY, "n_copies")
    lone = hashes.where("conv_id IS NULL").join(alone, _KEY).dropDuplicates(_KEY)
    both = rows.unionByName(lone.select(*rows.columns))
    said = F.concat(F.lit(TURN_OPEN), F.coalesce("role", F.lit(NO_ROLE)), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_CLOSE))
    parts = both.groupBy("conv_id", "h1", "h2", F.col("n").alias("n_turns"), "n_copies", F.expr(f"nth div {block}").alias("part"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("nth", said.alias("said")))), lambda t: t["said"])
    return parts.agg(F.array_join(each, "").alias("rendered")).drop("h1", "h2")
