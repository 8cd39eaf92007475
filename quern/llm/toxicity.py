"""Toxicity: a sparse linear classifier, regularised by counterfactuals.

A text's features are the words and word beginnings in its distinct
white-space-delimited chunks. The model is a logistic regression with an L1
penalty and with a penalty on score changes: in every labelled text that names a
group, identity terms are swapped for others of their set, and the squared change
of the raw score is part of the loss. Pairs of terms of a set are penalised too,
so that terms no labelled text holds stay neutral.

Defined results: null and empty texts get the score of no features; null doc_id
is scored; repeated rows get equal scores; no labels: 0.5 for all; labels of one
class: its smoothed rate; an empty table gives no rows; only doc_id and text are
read, whatever the other columns are named.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import crc_mod, texts_of
from quern.llm.quality import labelled_sample

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 8_000
THRESHOLD = 0.3
BITS = 20
#: Lengths of word beginnings that are features besides the whole word.
STARTS = (4, 5, 6)
#: Features kept for the fit, by how far their rates differ between the labels.
KEPT = 20_000
#: Weights of scored chunks kept in a worker's memo, which is emptied when full.
MEMO = 500_000

#: Sets of identity terms; a swap puts the next term of the set in a term's place.
IDENTITY_SETS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young", "elderly"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {t.encode(): s[(k + 1) % len(s)].encode() for s in IDENTITY_SETS for k, t in enumerate(s)}
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    parts = [word] + ["^" + word[:n] for n in STARTS if len(word) > n]
    return [zlib.crc32(p.encode("utf-8", "replace")) & mask for p in parts]


def chunk_features(chunk: bytes) -> list[int]:
    return [f for w in _LETTERS.findall(chunk.decode("utf-8", "replace").lower()) for f in word_features(w)]


def chunks(text: bytes | None) -> set[bytes]:
    return set(text.lower().split()) if text else set()


def swapped(found: set[bytes]) -> tuple[list[int], list[int]]:
    """Features that a swap of all identity terms removes and adds."""
    gone, new = [], []
    for c in found:
        word = c.strip(b".,;:!?\"'()[]")
        if word in _SWAP:
            gone += chunk_features(word)
            new += chunk_features(_SWAP[word])
    return gone, new


@dataclass
class Linear:
    weights: dict[int, float]
    base: float

    def score(self, texts: list[bytes | None], memo: dict[bytes, float]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        w = self.weights
        for i, t in enumerate(texts):
            found = chunks(t)
            if len(memo) > MEMO:
                memo.clear()
            have = list(map(memo.get, found))
            if None in have:
                for k, c in enumerate(found):
                    if have[k] is None:
                        memo[c] = have[k] = sum([w[f] for f in set(chunk_features(c)) if f in w])
            out[i] += sum(have)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, gone: list[np.ndarray], new: list[np.ndarray], l1: float | None = None, fair: float = 1.0, rounds: int = 300) -> Linear:
    """FISTA on logistic loss + l1 * |w| + fair * mean squared change of the raw score under swaps."""
    n = len(rows)
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return Linear({}, float(np.log(rate / (1 - rate))))
    # The prior behind the penalty is one: its share of the mean loss falls with the rows.
    l1 = 1.5 / n if l1 is None else l1
    size = 1 << BITS
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, int)
    pairs = np.unique(of.astype(np.int64) * size + flat)
    who, what = pairs // size, pairs % size
    one, all_ = np.bincount(what[y[who] > 0], minlength=size), np.bincount(what, minlength=size)
    a, b = (one + 0.5) / (y.sum() + 1), (all_ - one + 0.5) / (n - y.sum() + 1)
    worth = np.where(all_ >= 3, np.abs(a - b) / np.sqrt((a + b) / n), 0)
    swaps = [(np.array(chunk_features(t.encode())), np.array(chunk_features(s[(k + 1) % len(s)].encode()))) for s in IDENTITY_SETS for k, t in enumerate(s)]
    swaps += [(g, m) for g, m in zip(gone, new) if len(g) or len(m)]
    keep = np.zeros(size, bool)
    keep[np.argsort(-worth, kind="stable")[:KEPT]] = True
    keep &= worth > 0
    place = np.cumsum(keep) - 1
    hit = keep[what]
    who, what, m = who[hit], place[what[hit]], int(keep.sum())
    d_row = np.concatenate([np.full(len(g) + len(p), k) for k, (g, p) in enumerate(swaps)]).astype(int)
    d_col = np.concatenate([np.concatenate([g, p]) for g, p in swaps]).astype(int)
    d_val = np.concatenate([np.concatenate([-np.ones(len(g)), np.ones(len(p))]) for g, p in swaps])
    hit = keep[d_col]
    d_row, d_col, d_val = d_row[hit], place[d_col[hit]], d_val[hit]
    step = 4.0 / max(1.0, _norm(who, what, np.ones(len(who)), n, m) / n + 8 * fair * _norm(d_row, d_col, d_val, len(swaps), m) / len(swaps))
    w, base = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, v_base, t = w.copy(), base, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(who, v[what], n) + v_base, -30, 30)))
        change = np.bincount(d_row, v[d_col] * d_val, len(swaps))
        grad = np.bincount(what, (p - y)[who], m) / n + 2 * fair * np.bincount(d_col, change[d_row] * d_val, m) / len(swaps)
        w_next = v - step * grad
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - step * l1, 0)
        base_next = v_base - min(step, 1.0) * (p - y).mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_base = w_next + (t - 1) / t_next * (w_next - w), base_next + (t - 1) / t_next * (base_next - base)
        w, base, t = w_next, base_next, t_next
    names = np.flatnonzero(keep)
    return Linear({int(names[k]): float(w[k]) for k in np.flatnonzero(w)}, float(base))


def _norm(row, col, val, n: int, m: int) -> float:
    """The largest eigenvalue of X'X, by power iteration."""
    v, s = np.ones(m) / max(np.sqrt(m), 1), 1.0
    for _ in range(12):
        u = np.bincount(col, np.bincount(row, v[col] * val, n)[row] * val, m)
        s = float(np.linalg.norm(u))
        if s == 0:
            return 0.0
        v = u / s
    return 1.1 * s


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> Linear:
    """A model of labelled rows whose crc32 of the id, modulo ``folds``, is not ``held``."""

    def found(batches):
        import pyarrow as pa

        kind = pa.list_(pa.int32())
        for b in batches:
            texts = [chunks(t) for t in texts_of(b.column("text"))]
            x = [np.unique(np.array([f for c in s for f in chunk_features(c)], dtype=np.int32)) for s in texts]
            swaps = [swapped(s) for s in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, kind), pa.array([g for g, _ in swaps], kind), pa.array([p for _, p in swaps], kind)], ["doc_id", "y", "x", "gone", "new"])

    sample = labelled_sample(docs, labels, label, lambda d: crc_mod(d, folds) != held, rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    got = sample.mapInArrow(found, "doc_id long, y int, x array<int>, gone array<int>, new array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).toArrow()
    lists = {k: [np.asarray(a.values) for a in got[k]] for k in ("x", "gone", "new")}
    return fit_linear(lists["x"], np.array(got["y"].to_pylist(), dtype=np.float64), lists["gone"], lists["new"])


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        import pyarrow as pa

        memo: dict[bytes, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts_of(b.column(1)), memo))], names=["doc_id", "score"])

    schema = docs.select("doc_id").withColumn("score", F.lit(0.0)).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)
