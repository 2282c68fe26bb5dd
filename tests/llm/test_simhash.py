import random
import re

import numpy as np
import pytest
import xxhash

from roadpulse.llm import simhash
from roadpulse.llm.components import connected


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def plain_groups(fps, max_bits):
    """Smallest index reachable, by every pair."""
    n = len(fps)
    lab = list(range(n))
    changed = True
    near = [[j for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= max_bits] for i in range(n)]
    while changed:
        changed = False
        for i in range(n):
            m = min(lab[j] for j in near[i])
            if m < lab[i]:
                lab[i], changed = m, True
    return lab


def cloud(rng, n):
    """Random fingerprints with chains and balls of near ones."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        f = rng.choice(out)
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    ball = rng.getrandbits(64)
    out += [ball ^ (1 << i) ^ (1 << j) for i in range(0, 64, 7) for j in range(0, 64, 9)]
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "A B c", "É É é x", "a\x1cb c\xa0d e", "w " * 70000, "the Cat sat on THE mat " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_walk_equals_every_pair():
    rng = random.Random(4)
    x = np.unique(np.array(cloud(rng, 300), dtype=np.uint64))
    got = simhash.linked(x, len(x), 0, 2, True)
    assert got.tolist() == plain_groups([int(v) for v in x], 2)


@pytest.mark.parametrize("subtree,crowded", [(4096, 64), (40, 64), (16, 1)])
def test_links_over_subtrees(llm, subtree, crowded):
    """Cut at one, several and (by the second cut) many depths."""
    rng = random.Random(7)
    fps = sorted(set(cloud(rng, 200)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = llm.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected(simhash.links(df, 2, subtree, crowded)).collect()}
    got = {}
    for f, lab in zip(signed, plain_groups(fps, 2)):
        got.setdefault(lab, set()).add(roots.get(f, f))
    assert all(len(v) == 1 for v in got.values())
    assert len({next(iter(v)) for v in got.values()}) == len(got)


def fixture_rows():
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n)) for n in (300, 200, 5, 2)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, base[0].replace("a", "aa", 1)) for k in range(4)] + [(20, base[1].upper()), (20, base[1].upper())]
    return rows + [(30, None), (31, ""), (29, " \n"), (None, base[0]), (None, "quite alone here now"), (40, "x" * 300000)]


def test_documents(llm, docs_of):
    rows = fixture_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    lab = plain_groups(fps, 2)
    least = {}
    for (i, _), g in zip(rows, lab):
        least[g] = min([x for x in (i, least.get(g)) if x is not None], default=None)
    want = sorted((str(i), f"{f:016x}", str(least[g])) for (i, _), f, g in zip(rows, fps, lab))
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want

    docs = docs_of(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(v) for v in least.values())


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([])).count() == 0


def test_components(llm):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in connected(llm.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {a: find(a) for a in linked}
