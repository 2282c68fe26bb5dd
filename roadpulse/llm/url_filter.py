"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule is a host and the beginning of a path with a verdict; it fits its host
and all subdomains, and the longest fitting rule decides. URLs that no rule fits
are judged by a logistic regression on hashed character n-grams of host and
path (each with marks for its beginning and end, counted apart). It is trained
from a small labelled URL table (host, path, verdict) of its own, by default that of
``url_labels``; of a larger one, ``LABELLED`` rows by hash are taken.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: from there up to ``?``, ``#`` or the end.

Edge cases: a null URL, or one without ``://``, has an empty host and path, and
the model judges those like any other. Without labelled URLs, or with only one
verdict among them, the model gives that verdict (allow, if there is none).
Repeated rows get a row each; a null ``page_id`` stays null; an empty table gives
no rows. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_labels
from .common import blocks, mix64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)://([^/?#]*)([^?#]*)"
LABELLED = 4096
FEATURES, GRAMS = 1 << 16, (3, 4, 5)
STEPS, RATE, DECAY = 150, 0.5, 1e-5


@dataclass(frozen=True)
class Rule:
    verdict: str
    prefix: str  # host and path, as in ``example.com/en/``

    @property
    def host(self) -> str:
        return self.prefix.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.prefix[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.regexp_extract(url, SPLIT, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule], what) -> Column:
    """``what`` of the longest fitting rule, else null; rules are configuration."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def split_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    return parts.select(
        "*",
        longest_rule(h, p, rules, lambda r: r.prefix).alias("rule"),
        longest_rule(h, p, rules, lambda r: r.verdict).alias("ruled"),
    )


def labelled_urls(labelled: DataFrame, most: int = LABELLED) -> DataFrame:
    """host, path, verdict: at most ``most`` distinct rows."""
    known = labelled.select("host", "path", "verdict").where("verdict IN ('allow', 'block')").distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(most)


def _hashed(strings, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each string: (feature, index of the string)."""
    feats, rows = [], []
    for first, run in blocks(strings):
        buf = np.frombuffer(b"".join(b"\x02" + s + b"\x03" for s in run), dtype=np.uint8).astype(np.uint64)
        of = np.repeat(np.arange(len(run)), [len(s) + 2 for s in run])
        for n in GRAMS:
            m = len(buf) - n + 1
            if m <= 0:
                continue
            h = np.full(m, salt * 8 + n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(257) + buf[k : k + m]
            ok = of[:m] == of[n - 1 :]
            feats.append((mix64(h) & np.uint64(FEATURES - 1)).astype(np.int64)[ok])
            rows.append(first + of[:m][ok])
    if not feats:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(feats), np.concatenate(rows)


def features(hosts, paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, value) of each n-gram; a row's values have length one in
    all when its n-grams differ."""
    a, b = _hashed(hosts, 1), _hashed(paths, 2)
    feats, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    n = np.bincount(rows, minlength=len(hosts))
    return feats, rows, 1 / np.sqrt(n[rows])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts, paths) -> np.ndarray:
        feats, rows, value = features(hosts, paths)
        z = np.bincount(rows, weights=self.weights[feats] * value, minlength=len(hosts)) + self.bias
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


def train(labelled: pd.DataFrame) -> UrlModel:
    """Fit on columns host, path, verdict (a bounded table) by gradient descent
    with a step for each weight (Adagrad)."""
    y = (labelled["verdict"] == "block").to_numpy(float)
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return UrlModel(np.zeros(FEATURES), 50.0 if len(y) and y[0] else -50.0)
    feats, rows, value = features(labelled["host"].tolist(), labelled["path"].tolist())
    w, b, sq = np.zeros(FEATURES), 0.0, np.full(FEATURES + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(rows, weights=w[feats] * value, minlength=len(y)) + b
        e = (1 / (1 + np.exp(-z.clip(-50, 50))) - y) / len(y)
        g = np.append(np.bincount(feats, weights=e[rows] * value, minlength=FEATURES) + DECAY * w, e.sum())
        sq += g * g
        step = RATE * g / np.sqrt(sq)
        w, b = w - step[:-1], b - step[-1]
    return UrlModel(w, float(b))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """With ``labelled`` (host, path, verdict) or the built-in table:
    page_id, host, path, rule, verdict, block_score for each row of ``pages``."""
    parts = split_urls(pages, rules)
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(url_labels.labelled(), "host string, path string, verdict string")
    model = train(labelled_urls(labelled).toPandas())
    weights, bias = model.weights.astype(np.float32), model.bias

    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(UrlModel(weights, bias).block_probability(hosts.tolist(), paths.tolist()))

    scored = parts.withColumn("block_score", F.pandas_udf(score, "double")("host", "path"))
    own = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_score")
