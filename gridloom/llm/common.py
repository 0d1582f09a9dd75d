"""Shared parts of the corpus operators: whole texts to hashes in numpy, sizes, ranks and written tables.

Words are hashed to 64 bits straight from Arrow's UTF-8 buffers, so no Python object is made for a word. Two
different words (or shingles) share a hash with a chance of 2**-64 a pair; every operator that speaks of exact
words or shingles speaks of them up to that chance.
"""

from __future__ import annotations

import ctypes
import gc
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.storage import shared_folder as folder

SHINGLE = 5
NEAR = 0.8
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = [np.uint64(pow(0xD1342543DE82EF95, k, 2**64)) for k in range(64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: white space as ASCII has it, and everything of ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Lower-cased (A-Z only) bytes of some texts, without gaps, and where each text starts."""

    def __init__(self, column: pa.Array):
        column = pa.array(column, pa.large_string()) if not isinstance(column, pa.Array) else column.cast(pa.large_string())
        column = column.fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.raw = raw[off[0] : off[-1]] if len(off) else raw[:0]
        self.at = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.n = len(column)

    def words(self, separators: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, first word of each text and the end, byte at which each word starts)"""
        data = LOWER[self.raw] if lower else self.raw
        inside = ~separators[data]
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(self.n + 1, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | cut[1:n]]))
        end = np.flatnonzero(inside & np.concatenate([~inside[1:] | cut[1:n], [True]])) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(n)[0], dtype=np.uint64)])
            h = mix((total[end] - total[start]) * powers(n)[1][start])
        return h, np.searchsorted(start, self.at), start


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV)]
    return [p[:n] for p in _POWERS]


def shingles(h: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-word shingles in order, first of each text and the end); a text of fewer words has one, of all of them."""
    count = np.diff(at)
    short = (count > 0) & (count < k)
    n = np.where(count >= k, count - k + 1, short.astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = h[: len(h) - k + 1] * _Q[1]
            for j in range(1, k):
                s = s + h[j : len(h) - k + 1 + j] * _Q[j + 1]
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(n)), n)
        pos = at[:-1][text] + (np.arange(first[-1]) - first[:-1][text])
        out = np.zeros(first[-1], np.uint64)
        long = ~short[text]
        out[long] = s[pos[long]]
        for i in np.flatnonzero(short):
            out[first[i]] = _short(h[at[i] : at[i + 1]])
    return out, first


def _short(own: np.ndarray) -> np.uint64:
    """Fewer words than a shingle has: their number counts too, so that no longer sequence has the same hash by design."""
    value = (sum(int(w) * int(_Q[j + 1]) for j, w in enumerate(own)) + 7919 * len(own)) % 2**64
    return mix(np.array([value], np.uint64))[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory goes back to the system. Python workers live on after a task, beside their executor, and would hold what a task took at most."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Slices of a batch with about so many bytes in the column, a row at least. What a slice took is given back after it."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch[column]).fill_null(0)).astype(np.int64))])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        give_back()
        i = j


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str = "table", codec: str = "snappy", repeats: bool = True) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage, survives lost executors. If values do not repeat, no
    dictionary of them is tried."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.option("parquet.enable.dictionary", repeats).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes written tables that nothing will read any more, and lets Spark's cleaner remove the shuffle files of finished queries."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df).rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scan_bytes(df: DataFrame) -> int:
    """What the planner takes the input's size to be, in bytes; from file sizes, so no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str = "rank", per_salt: int = 1_000_000) -> DataFrame:
    """Adds a rank from 0 without gaps within each key. A key may hold any share of the rows: they are dealt over salts,
    ranked in each, and shifted by the counts of the salts before."""
    salts = max(256, -(-rows // per_salt))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int"))
    count = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = count.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(shift, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before")
