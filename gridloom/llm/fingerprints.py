"""Document fingerprints by I-Match over randomised lexica.

Document frequencies of all words of all texts are counted in a table of 2^20 cells (a word falls into one cell, so a count is
too high by about the mean of the cells at most; it is the same share of the corpus at any size). Terms whose inverse document
frequency ln(N / df), as a share of ln N, lies in the band stay, but those of a single document (misspelt and made-up words); they are made distinct and sorted, and hashed once for each lexicon: LEXICA random
subsets of all words at each of the rates 1, 1/2, 1/4, ... A fingerprint holds the three rates nearest to one expected term a
lexicon, so it tells degrees of likeness: the likeness of two fingerprints is, at the rates they share, the share of lexica with
equal hashes among those in which at least one of the two has a term.

Defined cases: a null text counts as empty; a text without any term in the band keeps all its words, one without words its whole
bytes, so equal texts always have equal fingerprints; of rows with one doc_id, the order is that of their texts; a null doc_id
comes first; a single row is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NON_ALNUM, Texts, chunks, mix, scan_bytes

CELLS = 1 << 20
BLOCK = 1 << 15
LEXICA = 32
#: Shares of ln N: 0.37 is a document frequency of N^0.63 (1.8 % of 50,000 texts). Beside it, terms need LEAST_TEXTS texts.
IDF_BAND = (0.37, 1.0)
LEAST_TEXTS = 2
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 65_536
_SALT = np.random.default_rng(11).integers(1, 2**63, LEXICA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Texts]:
    """Distinct (text, word hash) pairs, sorted; hashes keep their upper 44 bits beside a text's number of 20 bits."""
    texts = Texts(column)
    h, at, _ = texts.words(NON_ALNUM)
    pair = np.unique(np.repeat(np.arange(texts.n, dtype=np.uint64), np.diff(at)) << np.uint64(44) | h >> np.uint64(20))
    return (pair >> np.uint64(44)).astype(np.int64), mix(pair & np.uint64((1 << 44) - 1)), texts


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The table of cells over all texts, and the number of rows. Bounded: CELLS numbers come to the driver."""

    def count(batches):
        table, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                _, h, _ = terms(part["text"])
                table += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                rows += part.num_rows
        if rows:
            blobs = [zlib.compress(table[i : i + BLOCK].astype("<i8").tobytes(), 1) for i in range(0, CELLS, BLOCK)] + [rows.to_bytes(8, "little")]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def total(key, table):
        last = CELLS // BLOCK
        out = sum((np.frombuffer(b if key[0].as_py() == last else zlib.decompress(b), "<i8") for b in table["counts"].to_pylist()), np.zeros(1 if key[0].as_py() == last else BLOCK, np.int64))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.astype("<i8").tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(total, "block int, counts binary").collect()
    by = {r[0]: np.frombuffer(bytes(r[1]), "<i8") for r in found}
    if not by:
        return np.zeros(CELLS, np.int64), 0
    return np.concatenate([by[k] for k in range(CELLS // BLOCK)]), int(by[CELLS // BLOCK][0])


def banned(table: np.ndarray, rows: int, band: tuple[float, float] = IDF_BAND) -> np.ndarray:
    """Cells whose words lie outside the band. One rule at any size; a text of which nothing is left keeps all its words."""
    share = np.log(max(rows, 1) / np.maximum(table, 1)) / math.log(max(rows, 2))
    return (share < band[0]) | (share > band[1]) | (table < LEAST_TEXTS)


def fingerprints(column: pa.Array, outside: np.ndarray) -> list[str]:
    doc, h, texts = terms(column)
    keep = ~outside[(h >> np.uint64(44)).astype(np.int64)]
    none = np.bincount(doc[keep], minlength=texts.n) == 0
    keep |= none[doc]
    doc, h = doc[keep], h[keep]
    empty = np.flatnonzero(np.bincount(doc, minlength=texts.n) == 0)
    if len(empty):
        whole = [int.from_bytes(hashlib.blake2b(texts.raw[texts.at[i] : texts.at[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in empty]
        doc, h = np.concatenate([doc, empty]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    n = np.bincount(doc, minlength=texts.n)
    level = np.maximum(np.round(np.log2(np.maximum(n, 1))).astype(np.int64), 1)
    widest = np.where(level > 1, np.uint64(1) << (np.uint64(64) - (level - 1).astype(np.uint64)) % np.uint64(64), np.uint64(2**64 - 1))[doc]
    out = np.zeros((texts.n, 3, LEXICA), np.uint16)
    for j, salt in enumerate(_SALT):
        v = mix(h ^ salt)
        some = np.flatnonzero(v <= widest)
        d, own = doc[some], v[some]
        value = mix(own + salt)
        for k in range(3):
            rate = level[d] - 1 + k
            inside = (rate == 0) | (own >> (np.uint64(64) - np.maximum(rate, 1).astype(np.uint64)) == 0)
            total = np.zeros(texts.n, np.uint64)
            np.add.at(total, d[inside], value[inside])
            there = np.zeros(texts.n, bool)
            there[d[inside]] = True
            out[:, k, j] = np.where(there, (mix(total) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
    blob = out.reshape(texts.n, -1).astype(">u2")
    return [f"{level[i]:02x}{blob[i].tobytes().hex()}" for i in range(texts.n)]


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[2:]), ">u2").reshape(3, LEXICA) for s in (a, b))
    shift = int(b[:2], 16) - int(a[:2], 16)
    if abs(shift) > 2:
        return 0.0
    x, y = (x[shift:], y[: 3 - shift]) if shift >= 0 else (x[: 3 + shift], y[-shift:])
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (_bucket, _look, _k, doc_id, text): dealt by ranges of doc_id, each range with the first row of the following one, so that
    every row meets its successor inside its range. The bounds are quantiles of doc_id; each text is shuffled once."""
    spark = docs.sparkSession
    lowest = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_k", F.coalesce("doc_id", F.lit(lowest)))
    n = min(MAX_BUCKETS, max(64, scan_bytes(docs) // BUCKET_BYTES))
    bounds = rows.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 10 * n)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))
    # Bounds are doc_ids that occur, and a bucket starts at its bound: so all buckets but perhaps the first have rows, and their first keys are known.
    least = rows.agg(F.min("_k")).first()[0]
    if least is None:
        return rows.select(F.lit(0).alias("_bucket"), F.lit(0).alias("_look"), "_k", "doc_id", "text"), 1
    starts = np.unique(np.concatenate([[least], bounds[bounds > least]])).astype(np.int64)
    shared = spark.sparkContext.broadcast(starts)

    def deal(batches):
        starts = shared.value
        for batch in batches:
            for part in chunks(batch, "text", 16 << 20):
                k = part["_k"].to_numpy(zero_copy_only=False)
                bucket = np.searchsorted(starts, k, "right") - 1
                first = np.flatnonzero(starts[bucket] == k)
                for own, to, look in ((part, bucket, 0), (part.take(pa.array(first)), (bucket[first] - 1) % len(starts), 1)):
                    if own.num_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), look, np.int32)), own["_k"], own["doc_id"], own["text"]], names=["_bucket", "_look", "_k", "doc_id", "text"])

    dealt = rows.select("_k", "doc_id", "text").mapInArrow(deal, "_bucket int, _look int, _k long, doc_id long, text string")
    # A bucket's number is its partition; its rows are streamed, so a larger one takes time but no memory.
    return dealt.repartitionById(len(starts), F.col("_bucket")).sortWithinPartitions("_bucket", "_look", "_k", "text"), len(starts)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how like they and the next document's are."""
    table, rows = document_frequencies(docs)
    outside = docs.sparkSession.sparkContext.broadcast(banned(table, rows, band))
    dealt, _ = with_next(docs)

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """texts has one more than ids: what follows the last."""
        edited = []
        for a, b in zip(texts[:-1], texts[1:]):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        prints = fingerprints(pa.array(texts, pa.large_string()), outside.value)
        changed = fingerprints(pa.array(edited, pa.large_string()), outside.value)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(prints[:-1]),
                pa.array(changed),
                pa.array([likeness(a, b) for a, b in zip(prints, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        ids: list = []
        texts: list[str] = []
        size, bucket, done = 0, None, False
        for batch in batches:
            for b, look, doc, text in zip(*(batch[c].to_pylist() for c in ("_bucket", "_look", "doc_id", "text"))):
                if b != bucket:
                    bucket, ids, texts, size, done = b, [], [], 0, False
                if done:
                    continue
                text = text or ""
                texts.append(text)
                if look:  # the first row of the next range ends this one
                    if ids:
                        yield finish(ids, texts)
                    done = True
                    continue
                if size > 1 << 20:
                    yield finish(ids, texts)
                    ids, texts, size = [], [text], 0
                ids.append(doc)
                size += len(text)

    return dealt.select("_bucket", "_look", "doc_id", "text").mapInArrow(run, RESULT)
