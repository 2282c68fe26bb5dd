import itertools
import random
import re

import numpy as np

from roadpulse.llm import decontam


def words(t):
    return re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (t or "").lower())


def found(llm, docs, bench):
    """doc_id, contaminated and the items behind its classes, for each row."""
    rows = decontam.decontaminate(docs, bench).collect()
    table = {}
    for r in decontam.overlaps_of(docs, bench)[1].collect():
        table.setdefault(r["class_id"], set()).add(r["item_id"])
    out = []
    for r in rows:
        ids = set().union(*[table[c] for c in r["class_ids"]])
        assert r["contaminated"] == bool(r["class_ids"]) and r["n_classes"] == len(r["class_ids"])
        out.append((r["doc_id"], sorted(ids, key=lambda i: (i is None, i or 0))))
    return out


def seeded(a, b):
    return any(
        all(m == "0" or x == y for m, x, y in zip(mask, a[i:], b[i:]))
        for mask in decontam.MASKS
        for i in range(len(a) - len(mask) + 1)
    )


def plain(text, item):
    """Some aligned window of the item's size (15 at most) with four fifths equal."""
    d, q = words(text), words(item)
    if len(q) < decontam.SPAN:
        return False
    size = min(len(q), decontam.WINDOW)
    for i in range(len(d) - size + 1):
        for j in range(len(q) - size + 1):
            a, b = d[i : i + size], q[j : j + size]
            if sum(x == y for x, y in zip(a, b)) >= 0.8 * size:
                return True
    return False


def test_masks_meet_every_window():
    """All ways to substitute a fifth of a window."""
    for changed in itertools.combinations(range(decontam.WINDOW), 3):
        b = ["x" if k in changed else "o" for k in range(decontam.WINDOW)]
        assert seeded(["o"] * decontam.WINDOW, b)


def test_masks_meet_every_length():
    """All ways to substitute a fifth of an item, for every length up to a window."""
    for size in range(1, decontam.WINDOW + 1):
        for n in range(size // 5 + 1):
            for changed in itertools.combinations(range(size), n):
                whole = "".join("0" if k in changed else "1" for k in range(size))
                met = any(
                    all(m == "0" or w == "1" for m, w in zip(mask, whole[i:]))
                    for mask in decontam.MASKS_OF[size]
                    for i in range(size - len(mask) + 1)
                )
                assert met, (size, changed)


def test_items_of_every_length(llm, docs_of):
    """Items of 1 to 16 words, each whole and with every allowed substitution, and
    with one more than is allowed."""
    items, docs, want = [], [], []
    for n in range(1, 17):
        q = [f"i{n}w{k}" for k in range(n)]
        items.append(" ".join(q))
        size = min(n, decontam.WINDOW)
        for less in range(size // 5 + 2):
            for changed in itertools.islice(itertools.combinations(range(size), less), 100):
                docs.append(" ".join(["before"] * 3 + ["x" if k in changed else w for k, w in enumerate(q)] + ["after"] * 3))
                want.append([n - 1] if less <= size // 5 or (n > size and 0 in changed) else [])
    bench = llm.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = dict(found(llm, docs_of(list(enumerate(docs))), bench))
    assert [got[i] for i in range(len(docs))] == want


def test_repeated_places_are_paired_once(llm, docs_of):
    """A passage that many items and many documents repeat."""
    passage = " ".join(f"p{k}" for k in range(30))
    items = [(i if i else None, passage) for i in range(40)] + [(None, passage), (99, "other words than those of the passage")]
    docs = [(i, passage) for i in range(60)] + [(60, passage + " and more"), (61, "nothing")]
    bench = llm.createDataFrame(items, "item_id long, text string")
    made = decontam.item_seeds(bench)
    hits = decontam.document_seeds(docs_of(docs), decontam.bit_table(made), decontam.item_sizes(made))
    n = len(decontam.MASKS_OF[decontam.WINDOW]) * 30
    assert hits.join(made, "seed").count() > 40 * 60 * n // 2
    assert decontam.places(hits).count() <= 2 * n and decontam.places(made, "size").count() <= 2 * n
    got = dict(found(llm, docs_of(docs), bench))
    assert all(got[i] == [*range(1, 40), None] for i in range(61)) and got[61] == []


def counted(monkeypatch):
    """Pairs of places that are made, level by level."""
    made = []
    pair = decontam.paired

    def watched(*args):
        out = pair(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(decontam, "paired", watched)
    return made


def test_a_common_phrase_makes_no_product(llm, docs_of, monkeypatch):
    """300 documents and 300 items with one phrase in different surroundings."""
    phrase = "the answer to this question is that"
    around = lambda k, side: " ".join(f"{side}{k}w{j}" for j in range(12))
    items = [(k, f"{around(k, 'i')} {phrase} {around(k, 'j')}") for k in range(300)]
    docs = [(k, f"{around(k, 'd')} {phrase} {around(k, 'e')}") for k in range(300)] + [(300, items[7][1])]
    made = counted(monkeypatch)
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = dict(found(llm, docs_of(docs), bench))
    assert got[300] == [7] and not any(got[k] for k in range(300))
    assert sum(made) <= 2 * 600 * decontam.NARROW


def test_a_template_makes_no_product(llm, docs_of, monkeypatch):
    """300 items and 300 documents from one template: all overlap, through classes."""
    say = lambda k, side: " ".join([*(f"t{j}" for j in range(7)), f"{side}{k}", *(f"t{j}" for j in range(7, 14))])
    items, docs = [(k, say(k, "i")) for k in range(300)], [(k, "so " + say(k, "d") + " it is") for k in range(300)]
    made = counted(monkeypatch)
    bench = llm.createDataFrame(items, "item_id long, text string")
    rows = decontam.decontaminate(docs_of(docs), bench).collect()
    assert all(r["contaminated"] for r in rows)
    assert sum(r["n_classes"] for r in rows) <= 300 * 20 and sum(made) <= 600 * 100
    assert all(ids == list(range(300)) for _, ids in found(llm, docs_of(docs), bench))


def test_narrowing_loses_nothing():
    """Every allowed pattern of agreement keeps a narrowed key at every level."""
    for size in range(1, decontam.WINDOW + 1):
        for mask in decontam.MASKS_OF[size]:
            for state in decontam.first_states(mask, size):
                assert decontam.state_of(state.number()) == state
                left = [k for k in range(size) if k not in state.words]
                for changed in itertools.combinations(left, min(size // 5, len(left))):
                    s = state
                    while not s.proof:
                        s = next(n for n in s.narrowed() if not set(changed) & set(n.words))
                    assert size - len(s.words) <= size // 5


def test_crowded_places_equal_brute_force(llm, docs_of, monkeypatch):
    """With nothing paired below a proof."""
    docs, items = fixture(random.Random(5))
    docs = [d for d in docs if len(d or "") < 100000]
    bench = llm.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontam, "NARROW", 0)
    for i, ids in found(llm, docs_of(list(enumerate(docs))), bench):
        assert ids == [k for k, q in enumerate(items) if plain(docs[i], q)]


def fixture(rng):
    vocab = [f"w{i}" for i in range(12)] + ["é1", "The", "of"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [" ".join(say(n)) for n in (7, 9, 14, 15, 16, 40, 6, 3)] + [None, ""]
    docs = []
    for k in range(60):
        q = words(items[k % 8])
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            q[rng.randrange(len(q))] = "CHANGED"
        cut = rng.choice([0, 0, 3])
        docs.append(", ".join(say(rng.randint(0, 9)) + q[cut:] + say(rng.randint(0, 9))).upper())
    docs += [" ".join(say(50)) for _ in range(10)] + [None, "", items[3], items[3], " ".join(say(40000)), items[5] + "\n" + items[2]]
    return docs, items


def test_documents(llm, docs_of):
    docs, items = fixture(random.Random(11))
    rows = list(enumerate(docs)) + [(None, items[4]), (3, docs[3])]
    bench = llm.createDataFrame([(i, t, 5) for i, t in enumerate(items)], "item_id long, text string, seed int")
    got = sorted((str(i), bool(ids), ids) for i, ids in found(llm, docs_of(rows), bench))
    want = []
    for i, t in rows:
        hit = [k for k, q in enumerate(items) if plain(t, q)] if len(t or "") < 100000 else None
        want.append((str(i), hit))
    want.sort(key=lambda x: x[0])
    assert len(got) == len(want)
    by = {}
    for i, hit in want:
        by.setdefault(i, []).append(hit)
    for i, bad, ids in got:
        if by[i] != [None]:
            assert ids in by[i] and bad == bool(ids)
    assert any(bad for _, bad, _ in got) and not all(bad for _, bad, _ in got)
    kept = decontam.clean(docs_of(rows), bench)
    assert kept.count() == sum(not bad for _, bad, _ in got)


def test_empty(llm, docs_of):
    bench = llm.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs_of([]), bench).count() == 0
    assert [r["contaminated"] for r in decontam.decontaminate(docs_of([(1, "a b c d e f g h")]), bench).collect()] == [False]


def test_bit_table_keeps_every_item_seed(llm):
    _, items = fixture(random.Random(2))
    bench = llm.createDataFrame(list(enumerate(items)), "item_id long, text string")
    made = decontam.item_seeds(bench)
    bits = decontam.bit_table(made)
    seed = made.select("seed").toPandas()["seed"].to_numpy().view(np.uint64)
    assert len(seed) and all(bits[p].all() for p in decontam.probes(seed, len(bits)))
