"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy.

The statistics come from whole texts alone. Trees are grown to one depth on binned values (logistic loss); a tree is a row of arrays
of features, thresholds and leaves, so all documents of a batch walk down all trees by array indexing.

Labels are learnt from a sample of at most about SAMPLE labelled rows (chosen by a hash of doc_id, over all rows alike), of which
none has crc32(doc_id as text) mod 3 = 1. Only the sample's ids and statistics are sent, never texts.

Defined cases: a null text counts as empty, and both get a score; rows without labels, or with others than 0 and 1, are not learnt
from; with no labels at all, or one class only, every score is the share of class 1 (0.5 without any); repeated rows are scored
each; a null doc_id is not held out; other columns are ignored, or kept as they are by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import SPACES, Texts, chunks, fresh, shingles

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 60, 4, 64, 0.2, 8
NOT_LINE = np.zeros(256, bool)
NOT_LINE[10] = True


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _class("abcdefghijklmnopqrstuvwxyz"),
    "digit": _class("0123456789"),
    "space": _class(" \t\r\v\f"),
    "line": _class("\n"),
    "stop": _class(".,;:?"),
    "shout": _class("!"),
    "symbol": _class("#$%&*+<=>@\\^_`{}~"),
    "bar": _class("|/[]()"),
    "other": np.arange(256) >= 128,
}
FEATURES = [*_CLASSES, "bytes", "words", "word_bytes", "distinct", "top", "same_next", "same_second", "shingle_distinct", "lines", "line_distinct", "line_words"]


def statistics(column: pa.Array) -> np.ndarray:
    texts = Texts(column)
    h, at, _ = texts.words(SPACES)
    size, words = np.diff(texts.at).astype(float), np.diff(at).astype(float)
    n, w = np.maximum(size, 1), np.maximum(words, 1)

    def within(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    out = [within(mask[texts.raw], texts.at) / n for mask in _CLASSES.values()]
    doc = np.repeat(np.arange(texts.n), np.diff(at))

    def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and how often its most frequent one stands there; up to a clash of 44 bits."""
        pair, count = np.unique(owner.astype(np.uint64) << np.uint64(44) | values >> np.uint64(20), return_counts=True)
        own = (pair >> np.uint64(44)).astype(np.int64)
        most = np.zeros(texts.n)
        np.maximum.at(most, own, count)
        return np.bincount(own, minlength=texts.n).astype(float), most

    different, most = distinct(h, doc)
    following = [within(np.concatenate([(h[:-k] == h[k:]) & (doc[:-k] == doc[k:]) if len(h) > k else [], np.zeros(min(k, len(h)), bool)]), at) / w for k in (1, 2)]
    s, first = shingles(h, at)
    parts = np.diff(first).astype(float)
    s_distinct, _ = distinct(s, np.repeat(np.arange(texts.n), np.diff(first)))
    lines, line_at, _ = texts.words(NOT_LINE)
    n_lines = np.diff(line_at).astype(float)
    l_distinct, _ = distinct(lines, np.repeat(np.arange(texts.n), np.diff(line_at)))
    out += [np.log1p(size), np.log1p(words), (size - within(SPACES[texts.raw], texts.at)) / w, different / w, most / w, *following, s_distinct / np.maximum(parts, 1), np.log1p(n_lines), l_distinct / np.maximum(n_lines, 1), words / np.maximum(n_lines, 1)]
    return np.column_stack(out).astype(np.float32)


@dataclass
class Trees:
    """feature, threshold: [tree, inner node]; leaf: [tree, leaf]; base: the score of a document before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])  # bin b: value <= cuts[b]
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(len(y), base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, w = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            n, first = 2**depth, 2**depth - 1
            best, choice = np.full(n, 1e-9), [(0, -1)] * n
            for f in range(x.shape[1]):
                cell = (node - first) * BINS + binned[:, f]
                gs, ws, cs = (np.bincount(cell, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (g, w, np.ones(len(y))))
                right_g, right_w, right_c = gs[:, -1:] - gs, ws[:, -1:] - ws, cs[:, -1:] - cs
                gain = gs**2 / (ws + 1) + right_g**2 / (right_w + 1) - gs[:, -1:] ** 2 / (ws[:, -1:] + 1)
                gain[(cs < LEAST) | (right_c < LEAST)] = 0
                gain[:, len(cuts[f]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best
                for i in np.flatnonzero(better):
                    best[i], choice[i] = gain[i, b[i]], (f, int(b[i]))
            for i, (f, b) in enumerate(choice):
                if b >= 0:
                    feature[k, first + i], threshold[k, first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[k, node]] > threshold[k, node])
        own = node - inner
        leaf[k] = -RATE * np.bincount(own, g, leaves) / (np.bincount(own, w, leaves) + 1)
        total += leaf[k][own]
    return Trees(feature, threshold, leaf, base)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled documents that are not held out; docs may be any documents with the labels' ids."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1))))

    def measure(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                x = statistics(piece["text"])
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["_label"], pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    # About `sample` ids at most are broadcast, and as many rows of statistics come back.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(part), "doc_id").mapInArrow(measure, "doc_id long, label int, x array<float>").toPandas().sort_values(["doc_id", "label"])
    if found.empty:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return fit(np.stack(found["x"].to_numpy()).astype(np.float32), found["label"].to_numpy(float))


def with_score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """All columns as they are, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                score = shared.value.score(statistics(part["text"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(own, train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are predicted to be of class 1, all columns as they were."""
    own = fresh(docs, "_quality")
    return with_score(docs, train(docs, labels, sample), own).where(F.col(own) >= 0.5).drop(own)
