import warnings

import numpy as np
import pytest

from roadpulse.llm import mixing


def members(llm, t, p):
    rows = [((int(a), [float(v) for v in b]),) for a, b in zip(t, p)]
    return llm.createDataFrame(rows, "m struct<tokens: long, p: array<double>>").repartition(4)


def drawn(n=3000, seed=1, alpha=(4, 1, 0.6)):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 400, n), rng.dirichlet(alpha, n)


def nearest(columns, goal):
    """Exact nonnegative least squares by active sets: the nearest point to ``goal`` of the
    cone of ``columns``."""
    n = columns.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(1000):
        slope = columns.T @ (goal - columns @ x)
        slope[free] = -np.inf
        if slope.max() <= 1e-9 * max(1, np.abs(goal).max()):
            break
        free[slope.argmax()] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(columns[:, free], goal, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            bad = free & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return columns @ x


@pytest.mark.parametrize(
    "alpha,wanted",
    [((4, 1, 0.6), (0.94, 0.03, 0.03)), ((9, 0.3, 0.02), (0.5, 0.49, 0.01)), ((4, 1, 0.6), (1.0, 0.0, 0.0)), ((1, 1, 1), (0.1, 0.2, 0.7))],
)
def test_rates_equal_exact_least_squares(llm, alpha, wanted):
    """Targets that can and that cannot be met: the rest left is that of the exact optimum."""
    t, p = drawn(300, 4, alpha)
    targets = np.array(wanted) * t.sum()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = mixing.fit_rates(members(llm, t, p), "m", targets)
    rows = fit.rows.select("m.tokens", "m.p", fit.rate).collect()
    r, t, p = (np.array([x[i] for x in rows]) for i in (2, 0, 1))
    assert (r >= 0).all() and np.allclose((r * t) @ p, fit.totals)
    # The metric of the method: distances weighed by the inverse of G.
    root = np.linalg.cholesky(np.linalg.inv((p * t[:, None]).T @ p)).T
    best = nearest(root @ (p * t[:, None]).T, root @ targets)
    left = lambda total: np.sum((root @ (total - targets)) ** 2)
    least = np.sum((best - root @ targets) ** 2)
    assert left(fit.totals) - least <= 0.02 * (left(t @ p) - least)
    if wanted[0] == 0.94 and alpha[0] > 1:
        assert fit.gap <= mixing.CLOSE


def test_a_target_out_of_reach_is_said(llm):
    """A domain with hardly any tokens: the nearest mixture, its gap, and a warning."""
    t = np.array([50, 50, 100, 100, 3])
    p = np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 1, 0], [0.6, 0.3, 0.1]])
    with pytest.warns(UserWarning, match="nearest mixture"):
        fit = mixing.fit_rates(members(llm, t, p), "m", np.array([100.0, 200.0, 500.0]))
    assert fit.gap > mixing.CLOSE and fit.gap == pytest.approx(np.abs(fit.totals - [100, 200, 500]).max() / 800)


def test_stored_rates(llm, monkeypatch):
    """Rates that are stored on the way are the replayed ones."""
    t, p = drawn(400, 6, (9, 0.3, 0.02))
    goal = np.array([0.8, 0.15, 0.05]) * t.sum()
    one = mixing.fit_rates(members(llm, t, p), "m", goal)
    monkeypatch.setattr(mixing, "REPLAYED", 1)
    two = mixing.fit_rates(members(llm, t, p), "m", goal)
    assert np.allclose(one.totals, two.totals)
    assert np.allclose(sorted(r[0] for r in one.rows.select(one.rate).collect()), sorted(r[0] for r in two.rows.select(two.rate).collect()))


def fixture(llm):
    rows = []
    for i in range(400):
        text = ["the calm river flows home ", "*** $$$ !!! ", "you idiot fool "][0 if i % 4 < 2 else i % 4 - 1] * (3 + i % 5)
        rows.append((i, text + f"w{i % 37}"))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (5, rows[5][1]), (1002, "river " * 50000)]
    schema = "doc_id long, text string, rate string, member int, `__n` int, `__k` int, `p.q` string"
    docs = llm.createDataFrame([(i, t, "x", 3, 4, 5, "y") for i, t in rows], schema).repartition(3)
    labels = [(i, int(i % 4 != 2), int(i % 4 == 3)) for i in range(300)] + [(None, 1, 1), (7, None, None), (8, 1, None)]
    return rows, docs, llm.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixture(llm):
    rows, docs, labels = fixture(llm)
    got = mixing.mixture(docs, labels).toPandas()
    assert len(got) == len(rows) and (got["rate"] >= 0).all() and (got["copies"] >= 0).all()
    assert (got["copies"] - got["rate"]).abs().max() < 1
    assert np.allclose(got[["p_clean", "p_low", "p_toxic"]].sum(axis=1), 1)
    one = got[got["doc_id"] < 400]
    best = one[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(axis=1)
    want = [0 if i % 4 < 2 else int(i % 4 - 1) for i in one["doc_id"]]
    assert (best == want).mean() > 0.97
    share = (got["rate"] * got["tokens"]).to_numpy() @ got[["p_clean", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(share / share.sum(), list(mixing.TARGET_WEIGHTS.values()), atol=0.01)
    taken = mixing.mixed(docs, labels)
    assert taken.columns == docs.columns and taken.count() == got["copies"].sum()
    assert [tuple(r) for r in taken.drop("doc_id", "text").distinct().collect()] == [("x", 3, 4, 5, "y")]
    assert got["gap"].nunique() == 1 and got["gap"][0] <= mixing.CLOSE
    clean = one[one["p_clean"] > 0.99]
    assert (clean["copies"] >= 1).mean() > 0.98


def test_no_labels_and_empty(llm):
    _, docs, labels = fixture(llm)
    even = mixing.mixture(docs, labels.limit(0)).collect()
    assert len(even) == docs.count() and all(r["rate"] == 1 and r["copies"] == 1 and r["gap"] == 0 for r in even)
    assert mixing.mixed(docs, labels.limit(0)).count() == docs.count()
    assert mixing.mixture(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_posterior_is_evaluated_once(llm):
    from roadpulse.plans.inspect import plan_text

    _, docs, labels = fixture(llm)
    for df in (mixing.mixed(docs, labels), mixing.mixture(docs, labels)):
        assert "ArrowEvalPython" not in plan_text(df, "simple")  # read from the written rows
