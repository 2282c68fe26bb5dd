import zlib

import numpy as np

from roadpulse.llm import language

FR, EN = "le chat est dans la maison", "the cat is in the house"


def plain_bundle(text):
    cls, first = language._classes(), language._letters()
    seq = [0]
    for ch in (text or "") + " ":
        c = int(cls[ord(ch)])
        if c or seq[-1]:
            seq.append(c)
    out = np.zeros(language.DIM)
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        out += first[0][a] * first[1][b] * first[2][c]
    return out


def test_bundles_equal_plain():
    texts = [EN, None, "", "é", "A1b  c", "123", FR * 50, "x"] * 40
    made = language.bundles(texts)
    for t, v in zip(texts[:8], made):
        assert np.array_equal(v, plain_bundle(t))
    assert np.array_equal(made[:8], made[-8:])


def test_pieces_of_long_texts():
    runs = list(language.pieces(["abcdefgh", None, "", "xy"], 3))
    assert [p for r in runs for p in r] == [(0, "abc"), (0, "def"), (0, "gh"), (3, "xy")]


def test_identify(llm):
    rows = [(i, (EN if i % 2 else FR) + f" {'ab' * (i % 3)}", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 !!", "en"), (102, "", None), (None, EN, "en"), (103, "THE HOUSE", None), (103, "THE HOUSE", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    pred = {r["doc_id"]: r for r in got}
    for i, t, lang in rows:
        r = pred[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        want = "und" if not any(map(str.isalpha, t or "")) else "en" if i is None or i > 99 else lang
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(llm):
    docs = llm.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()] == [("und", 0.0)]
    assert language.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() > 0.97
