"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's evidence is a linear
function of its own features and those of the lines before and after it; a
transition weight ties neighbouring labels. Forward and backward messages over a
document's lines give each line's marginal, and the document's score is the
length-weighted mean of its lines' marginals, put on the scale of the labels by a
logistic fit on the learning documents.

Labels are known of documents only, and a document can have lines of both kinds. So the
lines get labels of their own first: a logistic regression on a line's own features, each
document counting once and both kinds of documents alike, says whether the line is of the
sort that good or that bad documents are made of. The field is learned from chains
labelled like this, which change within documents.

Learning takes documents with a label, at most ``LEARNING`` of them chosen by hash, with
at most ``LEARNING_BYTES`` of text. The features are computed on the cluster, the fit (a
few dozen weights) runs on the driver.

Edge cases: a null or empty text is one empty line and gets a score like any
other; a text of line feeds only has empty lines. Documents without any line
length weigh their lines equally. A null ``doc_id`` is neither held out nor learned
from. Without labels of both kinds every score is the share of good labels
(0.5 without labels). Labels that repeat a ``doc_id``, or contradict each other,
are learned from as they come; rows that repeat document and text are learned from once. Repeated rows get a row each; an empty table gives
no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, sample

LEARNING, LEARNING_BYTES = 3000, 48 << 20
FOLDS, THRESHOLD = 5, 0.3
STEPS, RATE, RIDGE = 150, 0.15, 1e-3

# Classes of bytes counted in each line.
_GROUPS = [
    range(65, 91),
    range(97, 123),
    range(48, 58),
    range(128, 256),
    b" \t\r\x0b\x0c",
    b"!?",
    b".,;:",
    b"|",
    b"*#$%&",
    b"/\\@=_~^+<>{}[]",
]
_GROUP = np.full(256, len(_GROUPS), dtype=np.uint8)
for _k, _g in enumerate(_GROUPS):
    _GROUP[list(_g)] = _k
_N = len(_GROUPS) + 1
OWN = _N + 5
WIDTH = 3 * OWN + 3


def line_features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, lines of each text)."""
    buf = np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    limits = np.cumsum([len(t) + 1 for t in run])
    lines = np.diff(np.searchsorted(ends, limits - 1, side="right"), prepend=0)
    group = _GROUP[buf]
    line = np.repeat(np.arange(len(ends)), size + 1)
    counts = np.bincount(line * _N + group, minlength=len(ends) * _N).reshape(-1, _N).astype(np.float64)
    counts[:, _N - 1] -= 1  # the line feed
    share = np.maximum(size, 1)[:, None]
    # Words, and words that repeat the one before them.
    space = (group == 4) | (buf == 10)
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    last = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    total = np.append(0, np.cumsum(buf.astype(np.int64) * (np.arange(len(buf)) % 8191 + 1)))
    weight = np.append(0, np.cumsum(buf.astype(np.int64)))
    word = (total[last] - total[first]) - (weight[last] - weight[first]) * (first % 8191)
    of = line[first]
    words = np.bincount(of, minlength=len(ends))
    same = (word[1:] == word[:-1]) & (of[1:] == of[:-1]) & ((last - first)[1:] == (last - first)[:-1])
    again = np.bincount(of[1:][same], minlength=len(ends))
    extra = np.stack(
        [
            np.log1p(size) / 5,
            size == 0,
            again / np.maximum(words, 1),
            np.minimum(words / share[:, 0], 1) * 5,
            (size > 0) & (buf[np.maximum(ends - 1, 0)] == 46),
        ],
        1,
    )
    return np.concatenate([counts / share, extra], 1).astype(np.float32), size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, whether there are such
    lines, and a constant."""
    first = np.zeros(len(x), dtype=bool)
    first[np.cumsum(lines) - lines] = True
    final = np.append(first[1:], True)
    out = np.zeros((len(x), WIDTH), dtype=np.float32)
    out[:, :OWN] = x
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[final, 2 * OWN : 3 * OWN] = 0
    out[:, -3], out[:, -2], out[:, -1] = first, final, 1
    return out


def _pass(odds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of good in the next line from those of this one. ``trans[i, j]``:
    weight of label i followed by label j."""
    stay = np.logaddexp(trans[0, 1], trans[1, 1] + odds)
    return stay - np.logaddexp(trans[0, 0], trans[1, 0] + odds)


def messages(evidence: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (evidence included) and backward log odds of each line.
    All documents step together, longest first, so a step works on those
    that still have a line."""
    order = np.argsort(-lines, kind="stable")
    count = lines[order]
    start = (np.cumsum(lines) - lines)[order]
    fwd, bwd = evidence.astype(np.float64), np.zeros(len(evidence))
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), side="right")
    for t in range(1, len(alive)):
        at = start[: alive[t]] + t
        fwd[at] += _pass(fwd[at - 1], trans)
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        bwd[at - 1] = _pass(evidence[at] + bwd[at], trans.T)
    return fwd, bwd


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    scale: float
    shift: float
    constant: float | None = None

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Probability of good for each line."""
        fwd, bwd = messages(with_neighbours(x, lines) @ self.weights, lines, self.trans)
        return _sigmoid(fwd + bwd)

    def mean_marginal(self, x, size, lines) -> np.ndarray:
        """Length-weighted mean over each document's lines."""
        doc = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(doc, weights=size, minlength=len(lines))
        weight = np.where(total[doc] > 0, size, 1.0)
        return np.bincount(doc, weights=weight * self.marginals(x, lines)) / np.bincount(doc, weights=weight)

    def score(self, run: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(run), self.constant)
        return _sigmoid(self.scale * _logit(self.mean_marginal(*line_features(run))) + self.shift)


def _adam(param: np.ndarray, gradient) -> np.ndarray:
    mean, square = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, STEPS + 1):
        grad = gradient(param) + RIDGE * param
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        param = param - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return param


def line_labels(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> np.ndarray:
    """0 or 1 for each line, from its own features: the kind of documents that lines like
    it are of. A line weighs its share of its document's bytes, a document one over the
    number of its kind. Empty lines tell nothing and take the label of the line before
    (the first ones that of the first line that is not empty)."""
    own = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    y = np.repeat(label, lines).astype(float)
    doc = np.repeat(np.arange(len(lines)), lines)
    total = np.maximum(np.bincount(doc, weights=size, minlength=len(lines)), 1)
    weight = size / total[doc] / np.bincount(label, minlength=2)[y.astype(int)]
    w = _adam(np.zeros(own.shape[1]), lambda w: own.T @ ((_sigmoid(own @ w) - y) * weight))
    made = (own @ w > 0).astype(np.int64)
    told = size > 0
    first = np.cumsum(lines) - lines
    at = np.where(told, np.arange(len(x)), -1)
    last = np.maximum.accumulate(at)
    ahead = np.minimum.accumulate(np.where(told, np.arange(len(x)), len(x))[::-1])[::-1]
    source = np.where(last >= first[doc], last, ahead)
    none = (source >= np.append(first[1:], len(x))[doc]) | (source < 0)
    return np.where(none, y.astype(np.int64), made[np.clip(source, 0, len(x) - 1)])


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> LineField:
    """Maximum likelihood of the lines' labels (Adam), then the scale of the
    document scores. ``label``: 0 or 1 for each document."""
    field = LineField(np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0)
    if not len(label) or label.min() == label.max():
        field.constant = float(label.mean()) if len(label) else 0.5
        return field
    full = with_neighbours(x, lines).astype(np.float64)
    y = line_labels(x, size, lines, label).astype(float)
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(lines) - lines] = False
    here = np.flatnonzero(inner)
    # A document counts once, however many lines it has.
    share = np.repeat(1 / lines, lines)

    def gradient(param: np.ndarray) -> np.ndarray:
        w, trans = param[:WIDTH], param[WIDTH:].reshape(2, 2)
        evidence = full @ w
        fwd, bwd = messages(evidence, lines, trans)
        grad = np.empty_like(param)
        grad[:WIDTH] = full.T @ ((_sigmoid(fwd + bwd) - y) * share) / len(label)
        after = evidence[here] + bwd[here]
        joint = np.stack([trans[i, j] + i * fwd[here - 1] + j * after for i in (0, 1) for j in (0, 1)], 1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint /= joint.sum(axis=1, keepdims=True)
        seen = np.zeros_like(joint)
        seen[np.arange(len(here)), (2 * y[here - 1] + y[here]).astype(int)] = 1
        grad[WIDTH:] = ((joint - seen) * share[here][:, None]).sum(axis=0) / len(label)
        return grad

    param = _adam(np.zeros(WIDTH + 4), gradient)
    field.weights, field.trans = param[:WIDTH].copy(), param[WIDTH:].reshape(2, 2).copy()
    z = _logit(field.mean_marginal(x, size, lines))
    ab = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps
        p = _sigmoid(ab[0] * z + ab[1])
        g = np.array([((p - label) * z).sum(), (p - label).sum()]) + 1e-3 * (ab - [1.0, 0.0])
        v = p * (1 - p)
        hess = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, g), -1, 1)
    field.scale, field.shift = float(max(ab[0], 1e-3)), float(ab[1])
    return field


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARNING, most_bytes: int = LEARNING_BYTES) -> LineField:
    """Fit on at most ``most`` labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~_held_out())
    rows = sample(docs, known, most, most_bytes)

    def made(batches):
        for pdf in batches:
            for first, run in blocks(pdf["text"]):
                x, size, lines = line_features(run)
                at = np.append(0, np.cumsum(lines))
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[first : first + len(run)].to_numpy(),
                        "quality": pdf["quality"].iloc[first : first + len(run)].to_numpy(),
                        "x": [x[a:b].tobytes() for a, b in zip(at, at[1:])],
                        "size": [size[a:b].astype(np.int64).tobytes() for a, b in zip(at, at[1:])],
                    }
                )

    schema = "doc_id long, quality int, x binary, size binary"
    found = rows.mapInPandas(made, schema).toPandas().sort_values(["doc_id", "quality", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(-1, OWN)
    size = np.frombuffer(b"".join(found["size"]), dtype=np.int64)
    lines = np.array([len(s) // 8 for s in found["size"]], dtype=np.int64)
    return fit(x, size, lines, found["quality"].to_numpy(dtype=np.int64))


def scorer(field: LineField):
    def score(texts: pd.Series) -> pd.Series:
        made = [field.score(run) for _, run in blocks(texts)]
        return pd.Series(np.concatenate(made) if made else np.empty(0))

    return F.pandas_udf(score, "double")


def line_marginals(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, good: the probability of good for each line of each text, in order."""

    def made(texts: pd.Series) -> pd.Series:
        out = []
        for _, run in blocks(texts):
            x, _, lines = line_features(run)
            good = field.marginals(x, lines) if field.constant is None else np.full(len(x), field.constant)
            out.extend(part.tolist() for part in np.split(good, np.cumsum(lines)[:-1]))
        return pd.Series(out)

    return docs.select("doc_id", F.pandas_udf(made, "array<double>")("text").alias("good"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (of a good document), predicted for each row."""
    made = docs.select("doc_id", _held_out().alias("held_out"), scorer(learn(docs, labels))("text").alias("score"))
    return made.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
