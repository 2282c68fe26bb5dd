"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of ``DIM`` signs. A trigram is the product
(binding) of its letters' vectors, each rotated by its place; a text is the sum
(bundle) of its trigrams, and a language the bundle of its learning texts. The
prediction is the language whose bundle has the highest cosine with the text's.

Characters are classed as a-z (either case), one of 37 classes for other letters
(by code point after lower-casing), or not a letter; runs of the last count as one
boundary, also before and after a text.

Learning counts trigrams by language over all learning rows inside the tasks and
adds the counts up on the cluster; at most (languages x trigram classes) sums
reach the driver, which bundles them.

Edge cases: a text that is null or has no letter gets ``und`` and score 0, and so
does every text when no row can be learned from. Rows with a null ``lang`` or
``doc_id`` are not learned from; a null ``doc_id`` is not held out. Equal cosines
go to the language first in order. Very long texts are counted piece by piece.
An empty table gives no rows. Other columns pass or are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES

DIM, CLASSES, SEED = 1024, 64, 20240607
# Pieces of text, and trigrams, whose counts are multiplied out at once.
PIECES, COLUMNS = 256, 1024
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1-26 a-z, above other letters."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return table


@functools.cache
def _letters() -> tuple[np.ndarray, ...]:
    """Letter vectors, rotated for the first, second and third place."""
    signs = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM)).astype(np.float32) * 2 - 1
    return tuple(np.roll(signs, 2 - place, axis=1) for place in range(3))


def trigram_vectors(ids: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return first[ids // CLASSES**2] * second[ids // CLASSES % CLASSES] * third[ids % CLASSES]


def pieces(texts, limit: int = BLOCK_BYTES):
    """Texts cut into pieces of at most ``limit`` characters, in runs of about
    that many: lists of (index of the text, piece)."""
    run, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), limit):
            piece = t[at : at + limit]
            if run and size + len(piece) > limit:
                yield run
                run, size = [], 0
            run.append((i, piece))
            size += len(piece)
    if run:
        yield run


def trigrams(run: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ids of a run of pieces, and the number of the piece of each."""
    joined = "".join(f" {t} " for _, t in run).encode("utf-32-le", "surrogatepass")
    cls = _classes()[np.frombuffer(joined, dtype=np.uint32)]
    starts = np.cumsum([0] + [len(t) + 2 for _, t in run])[:-1]
    keep = cls != 0
    keep[1:] |= cls[:-1] != 0
    keep[starts] = True
    of = np.repeat(np.arange(len(run), dtype=np.int32), np.add.reduceat(keep, starts, dtype=np.int64))
    c = cls[keep].astype(np.int32)
    ids = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    # A window needs a letter and must lie in one piece.
    ok = (of[:-2] == of[2:]) & ((c[:-2] | c[1:-1] | c[2:]) != 0)
    return ids[ok], of[:-2][ok]


def bundles(texts) -> np.ndarray:
    """One vector for each text (zero for a text without letters)."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for run in pieces(texts):
        ids, of = trigrams(run)
        if not len(ids):
            continue
        used = np.flatnonzero(np.bincount(ids, minlength=CLASSES**3))
        where = np.zeros(CLASSES**3, dtype=np.int64)
        where[used] = np.arange(len(used))
        for start in range(0, len(run), PIECES):
            n = min(PIECES, len(run) - start)
            a, b = np.searchsorted(of, (start, start + n))
            counts = np.bincount((of[a:b] - start) * np.int64(len(used)) + where[ids[a:b]], minlength=n * len(used))
            counts = counts.reshape(n, -1).astype(np.float32)
            sums = np.zeros((n, DIM), dtype=np.float32)
            for c in range(0, len(used), COLUMNS):
                sums += counts[:, c : c + COLUMNS] @ trigram_vectors(used[c : c + COLUMNS])
            np.add.at(out, [i for i, _ in run[start : start + n]], sums)
    return out


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit vectors), from the rows of ``docs``
    that are not held out."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                have = sums.setdefault(lang, np.zeros(CLASSES**3, dtype=np.int64))
                for run in pieces(texts):
                    have += np.bincount(trigrams(run)[0], minlength=CLASSES**3)
        for lang, have in sums.items():
            used = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "id": used, "n": have[used]})

    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select("lang", "text")
    found = rows.mapInPandas(count, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    made = np.zeros((len(langs), DIM), dtype=np.float64)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang].sort_values("id")
        made[k] = own["n"].to_numpy(np.float64) @ trigram_vectors(own["id"].to_numpy())
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    return langs, made / np.where(norm > 0, norm, 1)


def predictor(langs: list[str], prototypes: np.ndarray):
    """UDF of a text: struct lang_pred, score. The prototypes travel with it
    (``DIM`` numbers a language)."""
    protos = prototypes.astype(np.float32)

    def predict(texts: pd.Series) -> pd.DataFrame:
        made = bundles(texts.tolist())
        norm = np.linalg.norm(made, axis=1)
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        known = letters & bool(langs)
        pred, score = np.full(len(made), UNKNOWN, dtype=object), np.zeros(len(made))
        if langs:
            cos = made @ protos.T / np.where(norm > 0, norm, 1)[:, None]
            best = cos.argmax(axis=1)
            pred[known] = np.array(langs, dtype=object)[best[known]]
            score[known] = (1 + cos[np.arange(len(best)), best][known].astype(float).clip(-1, 1)) / 2
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    udf = predictor(*learn(docs))
    made = docs.select("doc_id", _held_out().alias("held_out"), udf("text").alias("p"))
    return made.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``."""
    udf = predictor(*learn(docs))
    return docs.where(udf("text")["lang_pred"] != UNKNOWN)
