"""Mixing sources to target weights with soft memberships.

Domains are what the labelled table tells apart: ``low`` quality, ``toxic``, and
``clean`` (the rest). A softmax regression on hashed words and character shares,
trained on at most ``LABELLED`` labelled documents chosen by hash, with at most
``LABELLED_BYTES`` of text, gives each document a posterior over the domains. It is
evaluated once and kept beside the document.

Rates: document d has t tokens, posterior p and a rate r >= 0; the expected
tokens of the domains are T = sum of r t p. Least squares brings T to the
targets, starting at r = 1, by projected gradient steps

    r <- max(0, r - p . a),    a = G^-1 (T - targets),  G = sum of t p p',

the gradient in the metric that weighs documents by tokens and domains by G. With
G over all documents the step is safe (its Lipschitz constant is one); with G over
the documents whose rate is not held at zero it is longer. Each round tries a few
lengths of both (``LONG``, ``SAFE``): the whole longer step, which changes the rates
least, if it gains ``GAIN`` of what is left, otherwise the one that leaves least. T and G are
aggregates over all documents, one pass a round; only these few numbers reach the driver,
and a document's rate is the replay of the steps on its own posterior, stored only every
``REPLAYED`` rounds.

The rounds end when the targets are met within ``CLOSE`` of the mixture's tokens, when a
step gains less than ``STALLED`` of what is left, or after ``ROUNDS``. Targets that no
mixture meets are approached, not reached (the tests compare with exact nonnegative least
squares). What is missing comes out with the result (``gap``: tokens that the domain
furthest from its target lacks or has too many, as a share of the mixture) and, above
``CLOSE``, as a warning.

A document is taken floor(r) times, and once more when its hash falls under the
rest of r.

Edge cases: null and empty texts have no tokens and the posterior of an empty
text; rates are theirs like any other's. Without labels the posterior is even and every rate
stays one: nothing is known to be mixed.
A domain that nothing belongs to is left out of the fit (its target cannot be
met and counts in the gap). Columns of the input may have any names. Repeated rows share a rate and are drawn together. An empty table gives
no rows. ``mixed`` returns the columns it is given.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, sample, text_key, tokens, written

DOMAINS = ("clean", "low", "toxic")
TARGET_WEIGHTS = {"clean": 0.94, "low": 0.03, "toxic": 0.03}
# Tokens of the mixture: so many that ``clean`` gets this multiple of its own.
CLEAN_MULTIPLE = 1.02
LABELLED, LABELLED_BYTES = 2000, 48 << 20
WORDS, BYTES = 4096, 128
STEPS, RATE, RIDGE = 300, 0.3, 1e-5
ROUNDS, REPLAYED, CLOSE, GAIN, STALLED = 60, 12, 1e-3, 0.3, 1e-3
LONG, SAFE = (1.5, 1.0, 0.5), (1.0, 8.0, 64.0)


def features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, tokens) of each text: hashed words, damped and of length one,
    and roots of the shares of the ASCII characters (0: all others)."""
    h, of = tokens(run)
    n = np.bincount(of, minlength=len(run))
    words = np.bincount(of * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(run) * WORDS)
    words = np.log1p(words.reshape(len(run), WORDS).astype(np.float32))
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    buf = np.frombuffer(b"".join(run), dtype=np.uint8)
    row = np.repeat(np.arange(len(run)), [len(t) for t in run])
    chars = np.bincount(row * BYTES + np.where(buf < BYTES, buf, 0), minlength=len(run) * BYTES).reshape(len(run), BYTES)
    chars = np.sqrt(chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return np.concatenate([words, chars], 1), n


def _small(run: list[bytes], most: int = 128):
    for i in range(0, len(run), most):
        yield i, run[i : i + most]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with a step for each weight (Adam)."""
    w = np.zeros((x.shape[1] + 1, k), dtype=np.float32)
    if not len(y):
        return w[:-1], w[-1]
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    goal = np.eye(k, dtype=np.float32)[y]
    share = (times / times.sum()).astype(np.float32)[:, None]
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = x1.T @ ((softmax(x1 @ w) - goal) * share) + RIDGE * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], w[-1]


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain (index into ``DOMAINS``) of the labelled rows."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    d = F.when(low, F.lit(1)).when(toxic, F.lit(2)).when(F.col("quality") == 1, F.lit(0))
    return labels.select("doc_id", d.alias("domain")).where("doc_id is not null and domain is not null")


def learn(
    docs: DataFrame, labels: DataFrame, most: int = LABELLED, most_bytes: int = LABELLED_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    rows = sample(docs, domain_labels(labels), most, most_bytes)

    def made(batches):
        for pdf in batches:
            for first, run in blocks(pdf["text"]):
                for at, some in _small(run):
                    x = features(some)[0].astype(np.float16)
                    own = pdf.iloc[first + at : first + at + len(some)]
                    yield own[["doc_id", "domain", "times"]].assign(x=[r.tobytes() for r in x])

    found = rows.mapInPandas(made, "doc_id long, domain int, times long, x binary").toPandas()
    found = found.sort_values(["doc_id", "domain", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float16).reshape(-1, WORDS + BYTES).astype(np.float32)
    return fit_softmax(x, found["domain"].to_numpy(dtype=np.int64), len(DOMAINS), found["times"].to_numpy(dtype=np.float64))


def posterior(model: tuple[np.ndarray, np.ndarray]):
    """UDF of a text: struct tokens, p (posterior over ``DOMAINS``)."""
    w, b = model

    def predict(texts: pd.Series) -> pd.DataFrame:
        n, p = [], []
        for _, run in blocks(texts):
            for _, some in _small(run):
                x, count = features(some)
                n.extend(count)
                p.extend(softmax(x @ w + b).astype(np.float64).tolist())
        return pd.DataFrame({"tokens": n, "p": p})

    return F.pandas_udf(predict, "tokens long, p array<double>")


def _dot(p: Column, a) -> Column:
    return sum((p[k] * F.lit(float(v)) for k, v in enumerate(a)), F.lit(0.0))


def rate(r: Column, p: Column, steps: list) -> Column:
    """A document's rate after more steps, replayed on its posterior."""
    for a in steps:
        r = F.greatest(F.lit(0.0), r - _dot(p, a))
    return r


def default_targets(present: np.ndarray, weights: dict[str, float] | None = None) -> np.ndarray:
    w = np.array([(weights or TARGET_WEIGHTS)[d] for d in DOMAINS], dtype=float)
    w = w / w.sum()
    return w * (CLEAN_MULTIPLE * present[0] / w[0] if present[0] > 0 else present.sum())


@dataclass
class Fit:
    rows: DataFrame  # the rows given, with the column ``rate``
    rate: str
    targets: np.ndarray
    totals: np.ndarray

    @property
    def gap(self) -> float:
        """Tokens that the domain furthest from its target misses it by, as a share of
        all tokens of the mixture."""
        return float(np.abs(self.totals - self.targets).max() / max(self.targets.sum(), 1e-12))


def fit_rates(
    rows: DataFrame, member: str, targets: np.ndarray | None = None, weights: dict[str, float] | None = None, labelled: bool = True
) -> Fit:
    """Rates for rows with a struct ``member`` (tokens, p); without ``labelled`` and targets
    all stay one."""
    k = len(DOMAINS)
    p, t = F.col(member)["p"], F.col(member)["tokens"]
    name = fresh(rows, "rate")
    rows = rows.withColumn(name, F.lit(1.0))

    def totals(steps: list, then: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """T and G after each of the steps in ``then``, all in one pass."""
        now = rows.select(rate(F.col(name), p, steps).alias("r"), t.alias("t"), *[p[i].alias(f"p{i}") for i in range(k)])
        own = F.array(*[F.col(f"p{i}") for i in range(k)])
        after = now.select("t", *[f"p{i}" for i in range(k)], *[rate(F.col("r"), own, [a]).alias(f"r{c}") for c, a in enumerate(then)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = []
        for c in range(len(then)):
            r, free = F.col(f"r{c}"), F.when(F.col(f"r{c}") > 0, F.col("t")).otherwise(0)
            sums += [F.sum(r * F.col("t") * F.col(f"p{i}")) for i in range(k)]
            sums += [F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]
        found = np.array([v or 0.0 for v in after.agg(*sums).first()], dtype=float).reshape(len(then), -1)
        out = []
        for row in found:
            gram = np.zeros((k, k))
            for (i, j), v in zip(pairs, row[k:]):
                gram[i, j] = gram[j, i] = v
            out.append((row[:k], gram))
        return out

    ((total, gram),) = totals([], [np.zeros(k)])
    if targets is None:
        targets = default_targets(total, weights) if labelled else total
    there = np.where(total > 0, 1.0, 0.0)
    safe = np.linalg.pinv(gram, rcond=1e-9)
    steps: list[np.ndarray] = []

    def left(total: np.ndarray) -> float:
        miss = (total - targets) * there
        return float(miss @ safe @ miss)

    for _ in range(ROUNDS):
        miss = (total - targets) * there
        if not total.any() or np.abs(miss).max() <= CLOSE * targets.sum():
            break
        free = np.linalg.pinv(gram, rcond=1e-9)
        tried = [f * free @ miss for f in LONG] + [f * safe @ miss for f in SAFE]
        after = totals(steps, tried)
        whole = LONG.index(1.0)
        gains = left(after[whole][0]) < (1 - GAIN) * left(total)
        best = whole if gains else min(range(len(tried)), key=lambda c: left(after[c][0]))
        if left(after[best][0]) >= (1 - STALLED) * left(total):
            break
        steps.append(tried[best])
        total, gram = after[best]
        if len(steps) == REPLAYED:
            rows, steps = written(rows.withColumn(name, rate(F.col(name), p, steps)), "rates"), []
    fit = Fit(rows.withColumn(name, rate(F.col(name), p, steps)), name, targets, total)
    if fit.gap > CLOSE:
        warnings.warn(f"the nearest mixture has {total.round(1).tolist()} tokens of {DOMAINS}, wanted {targets.round(1).tolist()}")
    return fit


def copies(r: Column, key: Column) -> Column:
    """Times a document is taken: the whole part of its rate, and one more when
    its hash (of ``doc_id`` and the key of its text) falls under the rest."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), key), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, one posterior column for each domain, rate, copies and gap (of the
    whole mixture) for each row of ``docs``."""
    model = learn(docs, labels)
    udf = posterior(model)
    rows = written(docs.select("doc_id", text_key().alias("tkey"), udf("text").alias("m")), "members")
    fit = fit_rates(rows, "m", weights=weights, labelled=bool(model[0].any()))
    p = [F.col("m.p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    taken = copies(F.col(fit.rate), F.col("tkey")).alias("copies")
    return fit.rows.select("doc_id", "m.tokens", *p, fit.rate, taken, F.lit(fit.gap).alias("gap"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs``, each row as many times as the mixture takes it."""
    model, member = learn(docs, labels), fresh(docs, "member")
    rows = written(docs.withColumn(member, posterior(model)("text")), "members")
    fit = fit_rates(rows, member, weights=weights, labelled=bool(model[0].any()))
    n = copies(F.col(fit.rate), text_key())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return fit.rows.select(*columns, n.alias(fit.rate)).where(F.col(fit.rate) > 0).select(*columns, F.explode(F.sequence(F.lit(1), fit.rate))).select(*columns)
