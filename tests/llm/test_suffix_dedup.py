import random

import numpy as np
import pytest

from roadpulse.llm import suffix_dedup
from roadpulse.llm.suffix_order import suffix_order


@pytest.mark.parametrize("symbols", [1, 2, 3, 200])
def test_suffix_order(symbols):
    rng = random.Random(symbols)
    for _ in range(400):
        text = [rng.randint(1, symbols) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    text = [1 + i % 3 for i in range(3000)] + [0]
    assert suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def plain(rows):
    size = suffix_dedup.LENGTH
    data = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, _), (n, b) in zip(rows, data):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < n:
                gone[k : k + size] = True
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), int(gone.sum()), int(spans), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, say(rng.randint(0, 60))) for i in range(30)]
    shared = [say(25) for _ in range(4)] + ["ab" * 60, "z" * 120]
    for i in range(30, 90):
        t = say(rng.randint(0, 20)) + rng.choice(shared) + say(rng.randint(0, 20))
        if rng.random() < 0.5:  # an edit inside what is shared
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "X", "YY"]) + t[k + 1 :]
        rows.append((i, t))
    base = rows[40][1]
    rows += [(200 + i, base) for i in range(15)] + [(7, base), (7, base + "!"), (None, base), (None, rows[3][1]), (None, None)]
    rows += [(300, base[:49]), (301, base[5:55]), (302, ""), (-5, rows[50][1]), (303, "q" * 5000), (1 << 40, "q" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowded,batch,bucket", [(20000, 2 << 20, 8 << 20), (20000, 900, 1500), (2, 700, 3000)])
def test_removed_bytes(docs_of, crowded, batch, bucket):
    """One batch; many batches; many batches with keys split as crowded."""
    rows = fixture(batch)
    got = suffix_dedup.remove_repeats(docs_of(rows), crowded, batch, bucket).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == plain(rows)


@pytest.mark.parametrize("piece", [50, 64, 101, 1000])
def test_long_texts_in_pieces(docs_of, piece):
    """Every text longer than a piece, with shared passages across the borders."""
    rows = fixture(piece)
    got = suffix_dedup.remove_repeats(docs_of(rows), 20000, 1500, 3000, piece).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == plain(rows)


def test_a_crowded_doc_id(docs_of):
    """A third of the rows have one doc_id: they fill many batches, and still remove
    nothing from one another."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(200)
    rows = [(5, say(30) + passage + say(rng.randint(0, 90))) for _ in range(60)] + [(100 + i, say(60) + passage[: rng.randint(20, 200)]) for i in range(120)]
    docs = docs_of(rows)
    parts = suffix_dedup.pieces(docs, 1000, True)
    assert parts.where("doc_id = 5").select("text").distinct().count() == 60
    got = suffix_dedup.remove_repeats(docs, 20000, 2000, 4000).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == plain(rows)


def test_a_very_long_text(docs_of):
    """Eight megabytes in one row, whose tail another row repeats."""
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 8 << 20, dtype=np.uint8)).decode()
    rows = [(1, text), (2, "new " + text[-3_000_000:] + " end"), (3, text[5 << 20 :][:100])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(rows)).collect()}
    assert got[1]["n_removed"] == 0 and bytes(got[1]["kept"]) == text.encode()
    assert (got[2]["n_removed"], got[2]["n_spans"], bytes(got[2]["kept"])) == (3_000_000, 1, b"new  end")
    assert got[3]["n_removed"] == 100


def test_small_chunks(docs_of, monkeypatch):
    """Long texts hashed and sorted piece by piece (in this process)."""
    monkeypatch.setattr(suffix_dedup, "SORTED", 300)
    import pandas as pd

    rows = fixture(5)
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"])
    one = suffix_dedup.Batch(pdf)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    two = suffix_dedup.Batch(pdf)
    assert one.count.sum() == two.count.sum() and len(one.count) <= len(two.count)
    assert set(one.key.tolist()) == set(two.key.tolist())
    e = two.shared_runs(np.unique(two.key))
    at = {f: getattr(e, f) for f in [*(f for f, _, _ in suffix_dedup._FIELDS), "identity"]}
    owner, begin = suffix_dedup.least_owners(at)
    for k in range(len(e.key)):
        run = int(np.flatnonzero(e.of_run == k)[0])
        for step in range(int(e.count[k])):
            s = int(e.start[run]) + step
            w = bytes(two.buf[s : s + 50])
            least = min(int(i) for i, t in zip(two.ids, two.texts) if w in t)
            assert owner[begin[k] + step] == least


def test_crowded_key(docs_of):
    """A phrase shorter than a window, with another context in every document, in
    few batches: no key has more contexts than fit one sort."""
    import pandas as pd

    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = say(42), say(90)
    rows = [(i, say(60) + phrase + say(60) + passage + say(60)) for i in range(300)]
    parts = [pd.DataFrame(rows[k::2], columns=["doc_id", "text"]) for k in range(2)]
    sent = pd.concat([suffix_dedup._keys_of(1)((k,), p) for k, p in enumerate(parts)])
    shared = suffix_dedup._shared_of(50)(sent)
    seen, split = {}, 0
    for k, p in enumerate(parts):
        known = suffix_dedup._shared_keys(shared[shared["batch"] == k])
        split += int((known & np.uint64(1)).sum())
        e = suffix_dedup.Batch(p).shared_runs(known)
        for key, identity in zip(e.key.tolist(), e.identity.tolist()):
            seen.setdefault(key, set()).add(identity)
    assert max(map(len, seen.values())) <= 50
    assert 0 < split < len(seen) and 30 * suffix_dedup.CROWDED <= suffix_dedup.SORTED
    got = suffix_dedup.remove_repeats(docs_of(rows), 50, 40000, 80000).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == plain(rows)


def test_empty(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0
