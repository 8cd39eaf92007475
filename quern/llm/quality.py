"""Quality classifier: histogram gradient-boosted trees over document statistics.

``fit`` learns on a bounded sample of labelled rows, ``score`` runs the trees,
flattened into arrays, over whole texts in Arrow batches.

Defined results: null and empty texts have all-zero statistics and get a score
like any other; null doc_id is scored too; repeated rows get equal scores; with no
usable labels every score is 0.5, with labels of one class it is that class's
smoothed rate; an empty table gives no rows; only doc_id and text are read, so
other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import crc_mod, texts_of, trimmed

#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Rows of an Arrow batch that are worked on at a time.
SLICE = 1_000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".!?",
    "comma": b",;:",
    "mark": b"#$%&*^~=_+|<>{}[]@\\/`",
    "bang": b"!",
    "bar": b"|",
    "brace": b"{}<>;=()",
    "high": bytes(range(128, 256)),
    "control": bytes([*range(9), *range(14, 32), 127]),
}
FEATURES = [
    *_CLASSES, "log_bytes", "log_words", "word_mean", "word_std", "word_max", "lines", "line_mean", "line_repeat", "distinct", "top_word",
    "adjacent", "pair_repeat", "no_letter", "symbol_end", "capital_word", "shout_word", "short_line", "links", "entropy",
]
_MARKED = re.compile(rb"[^A-Za-z0-9\s.,;:!?'\x80-\xff]{2,}(?:\s|$)|[!?]{2,}(?:\s|$)")
_SHOUT = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Z]{2,}(?![a-z\x80-\xff])")
_CAPITAL = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Z][a-z]")


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    hist = np.zeros((n, 256), dtype=np.float32)
    rest = np.zeros((n, len(FEATURES) - len(_CLASSES)), dtype=np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        hist[i] = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
        words, lines = t.split(), [x for x in t.split(b"\n") if x]
        m = max(len(words), 1)
        lens = np.fromiter(map(len, words), dtype=np.float32, count=len(words)) if words else np.zeros(1, dtype=np.float32)
        count: dict[bytes, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        same = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:])))
        rest[i] = (
            np.log1p(len(t)), np.log1p(len(words)), lens.mean(), lens.std(), np.log1p(lens.max()), len(lines) / m, np.log1p(len(t) / max(len(lines), 1)),
            1 - len(set(lines)) / max(len(lines), 1), len(count) / m, max(count.values(), default=0) / m, same / m, 1 - pairs / max(m - 1, 1),
            sum(1 for w in count if not w.isalpha() and not w[:1].isalpha() and w[0] < 128) / max(len(count), 1), len(_MARKED.findall(t)) / m,
            len(_CAPITAL.findall(t)) / m, len(_SHOUT.findall(t)) / m, sum(1 for x in lines if len(x) < 30) / max(len(lines), 1), t.count(b"http") / m, 0.0,
        )
    size = np.maximum(hist.sum(1, keepdims=True), 1)
    p = hist / size
    rest[:, -1] = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    member = np.zeros((256, len(_CLASSES)), dtype=np.float32)
    for k, chars in enumerate(_CLASSES.values()):
        member[list(chars), k] = 1
    return np.hstack([p @ member, rest])


@dataclass
class Trees:
    """Complete trees of equal depth: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while inner and at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.limit[tree, at])
        raw = self.base + (self.leaf[tree, at - inner].sum(1) if trees else 0)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30))) * np.ones(len(x))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Boosting with logistic loss; splits come from histograms of gradients over quantile bins."""
    n, width = x.shape
    if n == 0 or y.min(initial=2) == y.max(initial=-1):
        rate_ = (y.sum() + 1) / (n + 2) if n else 0.5
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(rate_ / (1 - rate_))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    code = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    feature, limit, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros((nodes, 3))
            slot = (at - first) * bins
            for k in range(width):
                key = slot + code[:, k]
                gs, hs, cs = (np.bincount(key, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, None))
                gr, hr, cr = gs[:, -1:] - gs, hs[:, -1:] - hs, cs[:, -1:] - cs
                gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain[(cs < least) | (cr < least)] = -1
                at_bin = gain.argmax(1)
                top = gain[np.arange(nodes), at_bin]
                better = top > best[:, 0] + 1e-9
                best[better] = np.stack([top, np.full(nodes, k), at_bin], 1)[better]
            for node in np.flatnonzero(best[:, 0] > 0):
                k, b = int(best[node, 1]), int(best[node, 2])
                if b < len(edges[k]):
                    feature[t, first + node], limit[t, first + node] = k, edges[k][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > limit[t, at])
        at -= inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = -rate * gs / (hs + l2)
        raw += leaf[t, at]
    return Trees(feature, limit, leaf, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """At most ``rows`` rows (doc_id, text, y) in hash order of the ids; a doc_id's label is its largest one."""
    order = F.xxhash64("doc_id")
    some = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(order, "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on labelled rows whose crc32 of the id, modulo ``folds``, is not ``held``."""

    def stats(batches):
        import pyarrow as pa

        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            x = features(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, label, lambda d: crc_mod(d, folds) != held, rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    # Repeated documents can't widen what reaches the driver.
    got = sample.mapInArrow(stats, "doc_id long, y int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float32).reshape(got.num_rows, len(FEATURES))
    return fit_trees(x, np.array(got["y"].to_pylist(), dtype=np.float64))


def score(docs: DataFrame, trees: Trees, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (doc_id) of every row, and the score as column ``name``."""
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).withColumn(name, F.lit(0.0)).schema
    text_at = None if "text" in keep else len(keep)

    def run(batches):
        import pyarrow as pa

        at = keep.index("text") if text_at is None else text_at
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            s = trees.score(features(texts_of(b.column(at)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s)], names=[*keep, name])
        trimmed()

    return docs.select(*keep, *([] if text_at is None else ["text"])).mapInArrow(run, schema)
