import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from roadpulse.llm import prefix_trie as pt
from roadpulse.llm.perfect_hash import Slots

SCHEMA = "conv_id long, turn long, role string, text string, depth int, h1 string, n long, words string"


def plain(rows, group=None, most=4):
    """Nodes by brute force: every prefix as a tuple of its turns."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = dict(own)
    if group:
        for c in own:
            h = zlib.crc32(str(c).encode()) % most
            seqs[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + own[c][h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, ms in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(o) == len(m) + 1 and o[:-1] == m for o in members)]
        saved = sum((len(members[m]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", m[-1][1])) if m else 0) for m in below)
        ends = sorted(c for c in ms if len(seqs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), up, len(ms), len(kids), len(leaves), saved, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(spark, rows, parts=4, **kw):
    frame = spark.createDataFrame([(*r, 9, "x", 3, "w") for r in rows], SCHEMA).repartition(parts)
    got = pt.prefix_trie(frame, **kw)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def some(seed, convs=60, most=6):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, most)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b c", "d\te\nf", ""])))
    return rows


EDGES = [
    (0, None, "user", "first"),
    (0, 0, "user", "second one"),
    (1, 1, None, None),
    (1, 1, None, None),
    (1, 1, "", ""),
    (21, 0, "user", "x " * 50000),
    (25, 0, "user", "x " * 50000),
    (22, 5, "user", " \t "),
    (-3, 0, "user", "below zero"),
    (-7, 0, "user", "below zero"),
    (None, 0, "user", "no conversation"),
    (None, 1, "user", "no conversation"),
    (40, 0, "a", "bc"),
    (41, 0, "ab", "c"),
]


@pytest.mark.parametrize("group", [None, 20])
def test_edges(llm, group):
    assert made(llm, EDGES, group=group) == plain(EDGES, group)


# Small bounds: heavy levels in bands, levels of several shards, long conversations in
# blocks, end numbers in parts.
@pytest.mark.parametrize("light,shard,band,block,bits", [(5, 7, 4, 2, 1), (1, 1, 1, 1, 0), (30, 10, 1000, 3, 16), (10**6, 10**6, 10**6, 4096, 16)])
def test_bounds_do_not_change_results(llm, light, shard, band, block, bits):
    rows = some(light)
    got = made(llm, rows, group=20, light=light, shard=shard, band=band, block=block, bits=bits)
    assert got == plain(rows, 20)


def test_crowded(llm):
    """One conversation with a third of the rows, one first turn for all, exact copies."""
    rows = [(c, 0, "user", "hello there") for c in range(90)] + [(c, 1, "bot", f"answer {c % 2}") for c in range(80)]
    rows += [(7, t, "user", f"turn {t % 3}") for t in range(2, 90)]
    assert made(llm, rows, light=40, shard=20, band=30, block=8, bits=3) == plain(rows)


def test_empty_and_no_conversation(llm):
    assert made(llm, [], group=20) == []
    assert made(llm, [(None, 0, "user", "x")]) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_slots(n):
    rng = np.random.default_rng(n)
    depth, high, low = rng.integers(0, 9, n), rng.integers(-(2**63), 2**63, n), np.arange(n)
    s = Slots(depth, high, low)
    assert sorted(s.slot) == list(range(n))
    assert (s.find(depth, high, low) == s.slot).all()
    assert (s.find(depth, high, low + n) == -1).all()
    assert (s.find(depth + 1, high, low) == -1).all()


def test_one_digest_for_two_prefixes_is_an_error(llm):
    rows = llm.createDataFrame(
        [(1, 2, 1, 5, 6, 0, 0, 7, 1), (2, 2, 1, 5, 6, 0, 0, 8, 1)],
        "conv_id long, n long, depth long, h1 long, h2 long, p1 long, p2 long, t3 long, words long",
    )
    with pytest.raises(Exception, match="one digest"):
        pt.enumerated(rows).collect()
