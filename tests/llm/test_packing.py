import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadpulse.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = packing.load(PATH)
ROWS = [
    (1, "One two  three\n\n four.\t five 's it's <|endoftext|> <|endoftext|>x"),
    (2, None),
    (3, ""),
    (3, ""),
    (None, "no id"),
    (2**62 + 1, "a large id"),
    (4, " "),
    (5, "  　 x᠎ ᠎ y \x1c z  \n"),
    (6, "word " * 60000),
    (7, "x" * 30000),
    (8, "Größe, çà 漢字 🙂🙂 ok"),
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_rebuild_documents(docs_of, plain):
    got = packing.pack(docs_of(ROWS), PATH).collect()
    want = {}
    for i, t in ROWS:
        want.setdefault(i, []).append(plain(t))
    # Rows that repeat an id cannot be told apart: only equal ones repeat here.
    have = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
        have.setdefault((r["doc_id"], r["start"]), []).append(r)
    for i, docs in want.items():
        for doc in docs:
            start, ids = 0, []
            while start < len(doc):
                r = have[i, start].pop()
                assert r["doc_tokens"] == len(doc)
                ids += np.frombuffer(r["ids"], "<u4").tolist()
                start += r["length"]
            assert ids == doc
    assert not any(have.values())


def test_numbers(docs_of):
    got = packing.pack(docs_of(ROWS, 5), PATH).select("sequence_id", "length").collect()
    ordered = sorted((r["sequence_id"], r["length"]) for r in got)
    assert len({s for s, _ in ordered}) == len(got) and 0 <= ordered[0][0] and ordered[-1][0] < 2**62
    assert [n for _, n in ordered] == sorted(n for _, n in ordered)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 4095, 6145, 100000])
def test_lengths(n):
    made = packing.lengths(n)
    assert sum(made) == n and made == sorted(made, reverse=True)
    assert len([m for m in made if m < 2048]) == bin(n % 2048).count("1")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 ᠎  ​　ab'sltveIÉ漢9.!_-<|>🙂")), max_size=40))
def test_units_equal_whole_text(text):
    made = np.frombuffer(packing.encoder(PATH).ids(text), "<u4").tolist()
    assert made == WHOLE.encode(text, add_special_tokens=False).ids


def test_full_table_and_slices(monkeypatch, plain):
    monkeypatch.setattr(packing, "UNITS", 5)
    monkeypatch.setattr(packing, "SLICE", 20)
    e = packing.Encoder(PATH)
    rng = random.Random(4)
    for _ in range(30):
        text = rng.choice(["", " ", "\n"]) + " ".join(rng.choice(["a", "bc", "def", "g,", "h" * 100, "i\nj", "漢字", "🙂"]) for _ in range(40))
        assert np.frombuffer(e.ids(text), "<u4").tolist() + [1] == plain(text)
    assert max(map(len, e.units.known)) <= packing.UNIT_CHARS and len(e.units.known) <= 50


def test_empty_table_and_bad_size(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of([]), PATH, 1000)


def test_query(llm, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: plain(r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_packing(llm, sf).collect()
    seen = {}
    for r in got:
        ids = texts[r["doc_id"]]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(x) for i, x in texts.items()}
