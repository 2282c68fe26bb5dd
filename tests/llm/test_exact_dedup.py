import hashlib
import random
import re

import numpy as np
import pytest

from roadpulse.llm import exact_dedup as ed
from roadpulse.llm.exact_dedup import digests, exact_duplicates, tree_merge


def plain(rows, largest=True):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, low):
        ids = [j for (j, _), u in zip(rows, low) if u == t]
        known = [j for j in ids if j is not None]
        keep = (max if largest else min)(known) if known else None
        out.append((str(i), str(keep), len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


ROWS = [(1, "Abc"), (2, "abc"), (3, "ABC"), (3, "ABC"), (None, "abc"), (4, "É"), (5, "é"), (6, None), (7, ""), (None, "lone"), (8, "abc "), (9, "z" * 400000), (10, "Z" * 400000)]


@pytest.mark.parametrize("largest", [True, False])
def test_rows(docs_of, largest):
    got = sorted((str(a), str(b), c, d, e) for a, b, c, d, e in exact_duplicates(docs_of(ROWS), largest).collect())
    assert got == plain(ROWS, largest)


def test_empty(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("rounds,bits", [(1, 1), (3, 2), (2, 4)])
def test_rounds_agree(docs_of, rounds, bits):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefgh") * rng.randint(0, 3)) for i in range(300)]
    got = {(r["keep_id"], r["group_size"]) for r in tree_merge(digests(docs_of(rows, 9)), rounds, bits).collect()}
    assert got == {(int(b), c) for _, b, c, _, _ in plain(rows)}


def entries_of(blocks):
    return [np.frombuffer(b, dtype=ed.ENTRY) for b in blocks]


def test_every_round_sends_sorted_runs(docs_of):
    """Blocks and the runs they make are sorted, lie with the holder their digests name so
    far, and hold each text at most once a run."""
    sizes = ed.Sizes(run=20, block=4, held=16)
    rng = random.Random(7)
    rows = [(i, rng.choice("abcdefghij") * rng.randint(0, 5)) for i in range(400)]
    docs = digests(docs_of(rows, 6))
    runs = ed.first_runs(docs, 3, 1, True, sizes)
    for turn in range(3):
        found = runs.collect()
        mask = (1 << (turn + 1)) - 1
        total = 0
        for r in found:
            (block,) = entries_of([r["block"]])
            keys = ed.digest_bytes(block)
            assert 0 < len(keys) <= 4 and keys == sorted(set(keys)) and keys[0] == bytes(r["first"])
            assert all(int(d[3]) & mask == r["holder"] & mask for d in block["digest"])
            total += int(block["count"].sum())
        assert total == 400
        if turn < 2:
            runs = ed.exchange(runs, turn + 1, 1, True, sizes)
    got = {(r["keep_id"], r["group_size"]) for r in ed.last_merge(runs, True, sizes).collect()}
    assert got == {(int(b), c) for _, b, c, _, _ in plain(rows)}


def test_merge_streams():
    """Of many long runs, a merge holds the overlap only."""
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(5):
        run = np.zeros(2000, dtype=ed.ENTRY)
        run["digest"] = rng.integers(0, 9000, (2000, 4)) * np.array([1, 0, 0, 0])
        run["keep"], run["known"], run["count"] = rng.integers(0, 10**6, 2000), 1, 1
        runs.append(ed.folded(ed.ordered(run), True))
    blocks = sorted((r[i : i + 16] for r in runs for i in range(0, len(r), 16)), key=lambda b: int(b["digest"][0, 0]))
    parts = list(ed.merged(iter(blocks), True, 64))
    assert max(map(len, parts)) < 400
    out = np.concatenate(parts)
    want = ed.folded(ed.ordered(np.concatenate(runs)), True)
    assert (out == want).all() and out["count"].sum() == 10000


def test_equal_digests_are_verified():
    """Entries of one digest but another length or second hash stay apart."""
    run = np.zeros(4, dtype=ed.ENTRY)
    run["length"], run["second"] = [1, 1, 2, 1], [5, 5, 5, 6]
    run["keep"], run["known"], run["count"] = [3, 9, 4, 1], [1, 0, 1, 1], 1
    assert sorted(ed.folded(ed.ordered(run), True)[["length", "second", "keep", "count"]].tolist()) == [(1, 5, 3, 2), (1, 6, 1, 1), (2, 5, 4, 1)]


def test_holders_follow_the_rows():
    assert [ed.rounds_for(n) for n in (0, 10**6, 5 * 10**8, 10**9, 10**12)] == [2, 2, 2, 3, 5]
