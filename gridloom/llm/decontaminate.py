"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (number of distinct shingles q, classes by powers of two). For a class of up to 2^c
shingles a document is cut into windows of 2^(c+1) shingles, one every 2^c, so that an item that stands in the
document stands whole in some window and makes up at least a quarter of its shingles. Each of HASHES MinHash values of
a window is looked up among those of the class's items; one equal value makes a candidate, and exact containment
|item & document| / |item| decides. An item that a document holds whole is overlooked with a chance of at most
(3/4)^HASHES, about 1e-4 for the smallest of its class and 1e-8 for the usual one.

The documents are only mapped: no shuffle, no group, no text leaves its task. Items come to the executors in blocks of
BLOCK_ITEMS, so what is sent is bounded, whatever the size of the benchmark.

Defined cases: null or empty texts hold nothing and are held by nothing; an item of fewer than five words is one
shingle of all its words and so is found only in a text of just these words; repeated rows of either table give a row
each; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NEAR, NON_ALNUM, Texts, chunks, shingles

HASHES = 32
BLOCK_ITEMS = 20_000
_A = np.random.default_rng(7).integers(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
LEAKS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


class Items:
    """An index of some benchmark items, as arrays."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, at, _ = Texts(pa.array(texts, pa.large_string())).words(NON_ALNUM)
        s, first = shingles(h, at)
        sets = [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]
        keep = [i for i, x in enumerate(sets) if len(x)]
        self.ids, self.sets = np.array([ids[i] for i in keep], np.int64), [sets[i] for i in keep]
        self.size = np.array([len(x) for x in self.sets], np.int64)
        level = np.ceil(np.log2(np.maximum(self.size, 1))).astype(int)
        self.classes = {}
        for c in np.unique(level):
            own = np.flatnonzero(level == c)
            tables = []
            for a in _A:
                v = np.array([(_low(self.sets[i]) * a).min() for i in own], np.uint32)
                order = np.argsort(v, kind="stable")
                tables.append((v[order], own[order]))
            self.classes[int(c)] = tables

    def candidates(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pairs (text, item), distinct, that share a MinHash value in some window."""
        found = [np.zeros((0, 2), np.int64)]
        texts = np.flatnonzero(np.diff(first))
        if not len(texts) or not self.classes:
            return found[0]
        low, n = _low(s), np.diff(first)
        for c, tables in self.classes.items():
            step = 1 << c
            # Blocks of `step` shingles; a window is a block and the next one of its text.
            blocks = -(-n // step)
            owner = np.repeat(np.arange(len(n)), blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = first[:-1][owner] + within * step
            paired = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) > 1 else np.zeros(0, np.int64)
            for a, (value, item) in zip(_A, tables):
                m = np.minimum.reduceat(low * a, starts)
                m[paired] = np.minimum(m[paired], m[paired + 1])
                lo, hi = np.searchsorted(value, m), np.searchsorted(value, m, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    k = hi[hit] - lo[hit]
                    which = np.repeat(lo[hit], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    found.append(np.column_stack([np.repeat(owner[hit], k), item[which]]))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, column: pa.Array, threshold: float) -> list[tuple[int, int, int]]:
        """(text, item, shared) for every pair at or over the threshold."""
        h, at, _ = Texts(column).words(NON_ALNUM)
        s, first = shingles(h, at)
        out, last, own = [], -1, None
        for text, item in self.candidates(s, first):
            if text != last:
                last, own = text, np.unique(s[first[text] : first[text + 1]])
            want = self.sets[item]
            pos = np.minimum(np.searchsorted(own, want), len(own) - 1)
            shared = int((own[pos] == want).sum())
            if shared >= threshold * len(want) - 1e-9:
                out.append((int(text), int(item), shared))
        return out


def item_blocks(benchmark: DataFrame, most: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The benchmark in blocks: each is fetched and indexed on its own."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    ids: list[int] = []
    texts: list[str] = []
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == most:
            yield Items(ids, texts)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = NEAR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and benchmark item of which it holds at least the threshold's share of shingles."""
    spark, out = docs.sparkSession, None
    for items in item_blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = shared.value.leaks(part["text"], threshold)
                    x = shared.value
                    ids = part["doc_id"].to_numpy(zero_copy_only=False) if part["doc_id"].null_count == 0 else np.array(part["doc_id"].to_pylist(), object)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if ids[t] is None else int(ids[t]) for t, _, _ in rows], pa.int64()),
                            pa.array([int(x.ids[i]) for _, i, _ in rows], pa.int64()),
                            pa.array([n for _, _, n in rows], pa.int64()),
                            pa.array([int(x.size[i]) for _, i, _ in rows], pa.int64()),
                            pa.array([n / float(x.size[i]) for _, i, n in rows], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = NEAR) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were. Maps the documents once for each block of items."""
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, "text"):
                    bad = {t for t, _, _ in shared.value.leaks(part["text"], threshold)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def brute_leaks(docs: pd.DataFrame, benchmark: pd.DataFrame, threshold: float = NEAR) -> set[tuple[int, int]]:
    """For tests: every pair compared."""
    import re

    def sets(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    of = [(d, sets(t)) for d, t in zip(docs.doc_id, docs.text)]
    return {(d, i) for i, t in zip(benchmark.item_id, benchmark.text) if (q := sets(t)) for d, x in of if len(q & x) >= threshold * len(q) - 1e-9}
