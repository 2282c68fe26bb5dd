import itertools

import numpy as np
import pytest

from roadpulse.llm import quality

GOOD, BAD = "The old mill stands by the river.", "BUY!! NOW!! *** | cheap | $$$"


def test_features_of_lines():
    texts = [b"Ab\n\nxx xx y.", b"", b"\n", "É!".encode()]
    x, size, lines = quality.line_features(texts)
    assert lines.tolist() == [3, 1, 2, 1] and size.tolist() == [2, 0, 8, 0, 0, 0, 3]
    alone = [quality.line_features([t])[0] for t in texts]
    assert np.allclose(x, np.concatenate(alone))
    assert x[2][quality._N + 2] == pytest.approx(1 / 3) and x[2][quality._N + 4] == 1


def test_messages_equal_every_labelling():
    rng = np.random.default_rng(3)
    lines = np.array([1, 4, 2, 6])
    evidence, trans = rng.normal(size=13) * 2, rng.normal(size=(2, 2))
    fwd, bwd = quality.messages(evidence, lines, trans)
    at = 0
    for n in lines:
        weight = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(evidence[at + k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
            for k in range(n):
                weight[k, y[k]] += np.exp(s)
        assert np.allclose(fwd[at : at + n] + bwd[at : at + n], np.log(weight[:, 1] / weight[:, 0]))
        at += n


def tables(llm, rows, labels):
    docs = llm.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    return docs, llm.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(llm):
    rows = [(i, "\n".join([GOOD if i % 3 else BAD] * (1 + i % 4)) + f" {i}") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, GOOD), (903, GOOD * 9000), (903, GOOD * 9000), (904, "\n".join([BAD] * 4000))]
    labels = [(i, int(i % 3 > 0), 0) for i in range(150)] + [(3, None, 0), (4, 1, 0), (None, 1, 0), (900, 1, 1)]
    docs, lab = tables(llm, rows, labels)
    got = quality.quality(docs, lab).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    by = got.set_index("doc_id")["predicted"]
    assert all(by[i] == int(i % 3 > 0) for i in range(200)) and by[904] == 0 and (by[903] == 1).all()


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_one_sided_labels(llm, labels, score):
    docs, lab = tables(llm, [(1, GOOD), (2, BAD)], labels)
    assert [r["score"] for r in quality.quality(docs, lab).collect()] == [score, score]


def test_the_border_inside_a_document(llm):
    """Half prose, half junk: both labels, with the border in place, on either side."""
    rows = [(i, "\n".join([[GOOD, BAD][j // 3 % 2 if i % 3 else 1] + f" {i * j % 7}" for j in range(2 + i % 9)])) for i in range(240)]
    rows += [(500, "\n".join([GOOD] * 8 + [BAD] * 8)), (501, "\n".join([BAD] * 5 + [""] + [GOOD] * 9)), (502, None), (503, GOOD)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(240)]
    docs, lab = tables(llm, rows, labels)
    field = quality.learn(docs, lab)
    got = {r["doc_id"]: [g > 0.5 for g in r["good"]] for r in quality.line_marginals(docs, field).collect()}
    assert got[500] == [True] * 8 + [False] * 8
    assert got[501][:5] == [False] * 5 and got[501][6:] == [True] * 9
    assert len(got[502]) == 1 and got[503] == [True]


def test_lines_of_labelled_documents(llm):
    """Empty lines take their neighbour's label; a document of them its own."""
    texts = [f"{GOOD}\n\n{BAD}\n", f"\n{GOOD}\n{GOOD}", f"{BAD}\n{BAD}\n\n{BAD}", "\n", ""] * 30
    x, size, lines = quality.line_features([t.encode() for t in texts])
    made = quality.line_labels(x, size, lines, np.array([1, 1, 0, 0, 1] * 30))
    assert np.split(made, np.cumsum(lines)[:-1])[:5] and [m.tolist() for m in np.split(made, np.cumsum(lines)[:-1])[:5]] == [
        [1, 1, 0, 0],
        [1, 1, 1],
        [0, 0, 0, 0],
        [0, 0],
        [1],
    ]


def test_learning_is_bounded(llm):
    """Repeated rows count once; texts beyond the bound of bytes are left out."""
    from roadpulse.llm.common import sample

    rows = [(1, "a" * 100)] * 50 + [(1, "b" * 100), (2, None), (3, "c" * 10**6)] + [(i, "d" * 50) for i in range(4, 40)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = llm.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = sample(docs, known, 30, 1000).collect()
    assert len(got) <= 30 and sum(len(r["text"] or "") for r in got) <= 1000
    assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    whole = sample(docs, known, 1000, 10**9).collect()
    assert len(whole) == len(set(rows)) and sum(r["times"] for r in whole) == len(rows)


def test_empty(llm):
    assert quality.quality(*tables(llm, [], [])).count() == 0


def test_held_out_accuracy(llm):
    read = lambda t: llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    made = quality.quality(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id").toPandas()
    assert (made["predicted"] == made["quality"]).mean() > 0.98
