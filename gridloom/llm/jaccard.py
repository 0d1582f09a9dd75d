"""N-gram Jaccard join in the metric space of shingle sets: exact, with pivots, Voronoi regions and triangle-inequality windows.

1. Texts to sets of 64-bit shingle hashes, in numpy. Texts of equal sets are one class. All shingles are dealt by hash into buckets,
   packed (no row for a shingle); a bucket tells how many of each text's shingles some other text has too. A text linked at t = 0.8 has
   at least 0.8 of its shingles in another text, so all other texts are done: they lie at over 0.2 from everything.
2. Of the classes that are left, linked ones must share one of their first |s| - ceil(t |s|) + 1 shingles (frequent ones last), and
   their sizes are in one or two neighbouring classes of ratio 1 / t. The smallest name among those that share a shingle and a pair of
   size classes is the hub of them all, and all that have a hub in common are a region: both ends of a link have one. A set is in as
   many regions as it has hubs, 1.3 on average in the check's data. Documents that share nothing lie at distance 1 from each other and
   from any document taken as pivot, which no Voronoi cell can split; so it is single shingles that make this first partition.
3. A region is joined in the Jaccard metric d = 1 - J. A pivot p is compared with all of it; what lies within 0.2 is linked and
   makes p's cell. Two members of one cell are connected already. Members x, y of two cells of different components can only be
   linked if d(p, q) <= 0.6, d(x, q) <= 0.4 and d(y, p) <= 0.4 (triangle inequality); such windows are compared exactly.
   A region of over MAX_ELEMENTS is first cut into Voronoi regions of sampled pivots, each with the rows of its window,
   d(x, q) <= d(x, nearest) + 0.4, again and again until regions are small or do not shrink.
4. Links become components. 2^-64 is the chance that two different shingles count as one.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text of fewer than five words
is one shingle of all of them; texts with equal sets are linked; repeated rows give a row each; rows with a null doc_id are linked
like others, and the component_id is null only if all of a component have none; keep_first keeps them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NEAR, SHINGLE, Texts, chunks, scan_bytes, shingles, written
from gridloom.llm.graph import components, maybe_in, without

BUCKET_BYTES = 2 << 20
MIN_BUCKETS, MAX_BUCKETS = 1_024, 1 << 20
CELLS = 1 << 20
MAX_ELEMENTS = 4_000_000
SPLIT_PIVOTS = 32


def sets_of(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, at, _ = Texts(column).words()
    s, first = shingles(h, at, k)
    return [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]


def _key(s: bytes) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _need(n: np.ndarray | int, t: float):
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


# Rows of step 1: bucket >= 0 has hashes and the numbers of their texts in the chunk; bucket < 0 has a chunk's own rows.
_PACKED = "bucket int, chunk long, a binary, b binary, c binary"


def _pack(buckets: int, k: int):
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", 16 << 20):
                # Hashing takes many times a text's bytes for a moment, so it goes by smaller pieces.
                sets = [s for piece in chunks(part, "text") for s in sets_of(piece["text"], k)]
                n = np.array([len(s) for s in sets], np.int64)
                keys = b"".join(_key(s.astype("<u8").tobytes()) for s in sets)
                ids = part["doc_id"]
                rows = [(-1 - chunk % 4096, np.array([0 if x is None else x for x in ids.to_pylist()], np.int64).tobytes() + np.packbits(np.asarray(ids.is_null())).tobytes(), n.astype("<i4").tobytes(), keys)]
                h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(sets), dtype="<u4"), n)
                # The upper bits deal, the next 32 are sent: that two shingles share both only makes step 1 keep more.
                place = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                low, doc, bounds = (h >> np.uint64(8)).astype("<u4")[order], doc[order], np.searchsorted(place[order], np.arange(buckets + 1))
                rows += [(b, low[x:y].tobytes(), doc[x:y].astype("<u2" if len(sets) <= 65_536 else "<u4").tobytes(), len(sets).to_bytes(8, "little")) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["bucket", "chunk", "a", "b", "c"])
                chunk += 1

    return run


def _shared(key, table):
    """Of a bucket: for each chunk, how many of each text's shingles another text has too."""
    if key[0].as_py() < 0:
        return table.set_column(0, "bucket", pa.array([-1] * table.num_rows, pa.int32()))
    rows = table.to_pylist()
    low = np.concatenate([np.frombuffer(r["a"], "<u4") for r in rows])
    texts = [int.from_bytes(r["c"], "little") for r in rows]
    base = np.concatenate([[0], np.cumsum(texts)])
    doc = np.concatenate([np.frombuffer(r["b"], "<u2" if n <= 65_536 else "<u4").astype(np.int64) + s for r, n, s in zip(rows, texts, base)])
    order = np.argsort(low, kind="stable")
    same = low[order][1:] == low[order][:-1]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    count = np.bincount(doc[order][again], minlength=base[-1])
    blobs = [count[x:y].astype("<u4").tobytes() if count[x:y].any() else None for x, y in zip(base[:-1], base[1:])]
    keep = [j for j, b in enumerate(blobs) if b]
    return pa.table({"bucket": pa.array([0] * len(keep), pa.int32()), "chunk": pa.array([rows[j]["chunk"] for j in keep], pa.int64()), "a": pa.array([blobs[j] for j in keep], pa.binary()), "b": pa.nulls(len(keep), pa.binary()), "c": pa.nulls(len(keep), pa.binary())})


_INFO = "doc_id long, n long, k1 long, k2 long, shared long"


def _sum(key, table):
    rows = table.to_pylist()
    own = next(r for r in rows if r["bucket"] < 0)
    n = np.frombuffer(own["b"], "<i4").astype(np.int64)
    ids = np.frombuffer(own["a"][: 8 * len(n)], np.int64)
    null = np.unpackbits(np.frombuffer(own["a"][8 * len(n) :], np.uint8))[: len(n)].astype(bool)
    shared = sum((np.frombuffer(r["a"], "<u4").astype(np.int64) for r in rows if r["bucket"] >= 0), np.zeros(len(n), np.int64))
    k = np.frombuffer(own["c"], "<i8").reshape(-1, 2)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "n": pa.array(n), "k1": pa.array(k[:, 0]), "k2": pa.array(k[:, 1]), "shared": pa.array(shared)})


def shared_counts(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n, k1 and k2 (hash of the set), shared: how many of its n shingles another text has too, or a few more."""
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, scan_bytes(docs) // BUCKET_BYTES))
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(buckets, k), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_shared, _PACKED).groupBy("chunk").applyInArrow(_sum, _INFO)


def _sets_table(docs: DataFrame, k: int) -> DataFrame:
    """rep (the name of the set), s (its shingle hashes, little-endian)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [s.astype("<u8").tobytes() for s in sets_of(part["text"], k)]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(_key(s)[:8], "little", signed=True) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["rep", "s"])

    return docs.select("text").mapInArrow(run, "rep long, s binary")


def _cells(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each of CELLS cells; bounded, whatever the number of sets."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in batch["s"]:
                np.add.at(total, (np.frombuffer(s.as_buffer(), "<u8") >> np.uint64(44)).astype(np.int64), 1)
        import zlib

        step = CELLS // 16
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([zlib.compress(total[i * step : (i + 1) * step].astype("<i8").tobytes(), 1) for i in range(16)], pa.binary())], names=["part", "a"])

    def add(key, table):
        import zlib

        total = sum(np.frombuffer(zlib.decompress(b), "<i8") for b in table["a"].to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "a": pa.array([total.tobytes()], pa.binary())})

    by = {r[0]: np.frombuffer(bytes(r[1]), "<i8") for r in sets.select("s").mapInArrow(run, "part int, a binary").groupBy("part").applyInArrow(add, "part int, a binary").collect()}
    return np.concatenate([by[i] for i in range(16)]) if by else np.zeros(CELLS, np.int64)


def _prefixes(sets: DataFrame, t: float) -> DataFrame:
    """h, c, rep: the shingles of which linked sets share one, each with both pairs of size classes that the set belongs to. Order:
    frequent cells last, by powers of two of their count, then by hash."""
    cells = _cells(sets)
    mean = max(1.0, float(cells.mean()))
    width = math.log(1 / t) * (1 + 1e-6)  # a little wider, so that rounding never parts sizes of ratio t by two classes
    level = sets.sparkSession.sparkContext.broadcast(np.floor(np.log2(np.maximum(cells / (4 * mean + 12), 1))).astype(np.uint8))

    def run(batches):
        for batch in batches:
            reps, out, sizes = [], [], []
            for rep, blob in zip(batch["rep"].to_pylist(), batch["s"]):
                s = np.frombuffer(blob.as_buffer(), "<u8")
                order = np.lexsort((s, level.value[(s >> np.uint64(44)).astype(np.int64)]))
                own = s[order[: len(s) - int(_need(len(s), t)) + 1]]
                c = int(math.log(len(s)) / width)
                reps.append(np.full(2 * len(own), rep, np.int64))
                out += [own, own]
                sizes += [np.full(len(own), c, np.int32), np.full(len(own), c + 1, np.int32)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(reps))], names=["h", "c", "rep"])

    return sets.mapInArrow(run, "h long, c int, rep long")


class Region:
    """Sets of one region, with postings, so that one set is compared with all at the cost of the elements they share."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.size = ids, np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        names, element = np.unique(np.concatenate(sets), return_inverse=True)
        self.element, self.first = element.astype(np.int32), np.concatenate([[0], np.cumsum(self.size)])
        order = np.argsort(self.element, kind="stable")
        self.posting, self.at = owner[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(element, minlength=len(names)))])

    def similarity(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(intersections, unions) of set i with all."""
        e = self.element[self.first[i] : self.first[i + 1]]
        lo, n = self.at[e], self.at[e + 1] - self.at[e]
        pos = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.posting[pos], minlength=len(self.ids))
        return both, self.size + self.size[i] - both

    def links(self, t: float) -> list[tuple[int, int]]:
        """Links that connect what is connected in the region; exact."""
        num, den = (int(round(t * 100)), 100)
        n, out = len(self.ids), []
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def join(i: int, js: np.ndarray) -> None:
            for j in js:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((self.ids[i], self.ids[int(j)]))

        def near(both: np.ndarray, union: np.ndarray, slack: int) -> np.ndarray:
            """Within (1 - t) * slack in the metric: J >= 1 - slack * (1 - t)."""
            return np.flatnonzero((den * both >= (den - slack * (den - num)) * union) & (both > 0))

        home = np.full(n, -1)
        pivots: list[int] = []
        windows: dict[int, np.ndarray] = {}  # what lies within 2 (1 - t) of a pivot: whatever could be linked with its region
        around: dict[int, np.ndarray] = {}  # the pivots' like of 3 (1 - t)
        for i in np.argsort(-self.size, kind="stable"):
            if home[i] >= 0:
                continue
            both, union = self.similarity(int(i))
            own = near(both, union, 1)
            join(int(i), own)
            home[own[home[own] < 0]] = i
            home[i] = i
            pivots.append(int(i))
            windows[int(i)], around[int(i)] = near(both, union, 2), near(both, union, 3)
        whole = np.zeros(n, bool)  # compared with all of the region, so none of its links is open
        whole[pivots] = True
        for p in pivots:
            for q in around[p].tolist():
                if home[q] != q or q <= p or find(p) == find(q):
                    continue
                x = windows[q][home[windows[q]] == p]
                y = windows[p][home[windows[p]] == q]
                if whole[x].all() or whole[y].all() or not len(x) or not len(y):
                    continue
                for i in (x if (~whole[x]).sum() <= (~whole[y]).sum() else y).tolist():
                    if not whole[i]:
                        join(i, near(*self.similarity(i), 1))
                        whole[i] = True
                        if find(p) == find(q):
                            break
        return out


def _region_links(t: float):
    def run(key, table):
        ids = table["rep"].to_pylist()
        first = {r: j for j, r in reversed(list(enumerate(ids)))}  # a set may come by more than one window
        keep = sorted(first.values())
        found = Region([ids[j] for j in keep], [np.frombuffer(table["s"][j].as_buffer(), "<u8") for j in keep]).links(t) if len(keep) > 1 else []
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return run


def _large(sizes: DataFrame, most: int) -> dict[int, int]:
    """Regions of over `most` elements: fewer than all elements / most. sizes: (region, n)."""
    return {r[0]: r[1] for r in sizes.groupBy("region").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") > most).collect()}


def _split(rows: DataFrame, sizes: DataFrame, t: float, most: int) -> DataFrame:
    """Cuts regions of over `most` elements at sampled pivots; rows (region, rep, s). Without any, the rows are not even made here."""
    large = _large(sizes, most)
    if not large:
        return rows
    rows = written(rows, "rows")
    done: DataFrame | None = None
    before: dict[int, int] = {}
    while True:
        large = _large(rows.select("region", (F.length("s") / 8).alias("n")), most)
        stuck = [r for r, n in large.items() if n > 0.9 * before.get(r, math.inf)]
        large = {r: n for r, n in large.items() if r not in stuck}
        if not large:
            return rows if done is None else done.unionByName(rows)
        inside = F.col("region").isin(list(large))
        small = rows.where(~inside)
        done = small if done is None else done.unionByName(small)
        per = max(4, SPLIT_PIVOTS // len(large))
        pivots: dict[int, list[np.ndarray]] = {}
        for r in large:  # `per` sets of each, by a hash of their ids
            for x in rows.where(F.col("region") == r).orderBy(F.xxhash64("rep")).limit(per).collect():
                pivots.setdefault(r, []).append(np.frombuffer(bytes(x["s"]), "<u8"))
        shared = rows.sparkSession.sparkContext.broadcast(pivots)
        slack = 2 * (1 - t) + 1e-9

        def deal(batches, shared=shared):
            for batch in batches:
                out = []
                for region, rep, blob in zip(batch["region"].to_pylist(), batch["rep"].to_pylist(), batch["s"]):
                    s = np.frombuffer(blob.as_buffer(), "<u8")
                    own = shared.value[region]
                    both = np.array([np.isin(p, s, assume_unique=True).sum() for p in own], float)
                    d = 1 - both / (np.array([len(p) for p in own]) + len(s) - both)
                    near = d.min()
                    # The last region is that of sets that share nothing with any pivot.
                    to = [j for j in range(len(own)) if d[j] < 1 and d[j] <= near + slack] + [len(own)] * int(near >= t - 1e-9)
                    out += [(int(np.int64(np.uint64((region * 1_000_003 + j + 1) % 2**64).view(np.int64))), rep, blob.as_py(), int(region)) for j in to]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.int64())], names=["region", "rep", "s", "parent"])

        dealt = written(rows.where(inside).mapInArrow(deal, "region long, rep long, s binary, parent long"), "regions")
        before = {r[0]: large[r[1]] for r in dealt.groupBy("region", "parent").agg(F.sum(F.length("s") / 8).alias("n")).where(F.col("n") > most).select("region", "parent").collect()}
        rows = dealt.select("region", "rep", "s")


def near_components(docs: DataFrame, t: float = NEAR, k: int = SHINGLE, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    info = written(shared_counts(docs, k), "info")
    has = F.col("n") > 0
    classes = written(info.where(has).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max(F.col("shared") >= F.ceil(F.col("n") * t - 1e-9)).alias("open")), "classes")
    reps = written(classes.where("open").select(F.col("rep").alias("doc_id"), F.col("k1").alias("rep")), "reps")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = maybe_in(own, "doc_id", reps.where("doc_id is not null")).join(reps.select("doc_id").distinct(), "doc_id", "left_semi")
    # A class of rows without doc_id only is found by its set among all rows without one.
    texts = texts.unionByName(own.where("doc_id is null").select(*texts.columns))
    # Rows of one doc_id with other texts are no harm: what counts is the set, whose hash k1 is its name from here on.
    sets = _sets_table(texts, k).join(reps.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    sets = written(sets, "sets")
    prefix = written(_prefixes(sets, t), "prefixes")
    hubs = written(prefix.groupBy("h", "c").agg(F.min("rep").alias("region"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "c", "region"), "hubs")
    members = written(prefix.join(hubs, ["h", "c"]).select("region", "rep").distinct(), "members")
    sizes = members.join(sets.select("rep", (F.length("s") / 8).alias("n")), "rep").select("region", "n")
    rows = members.join(sets, "rep").select("region", "rep", "s")
    links = _split(rows, sizes, t, max_elements).groupBy("region").applyInArrow(_region_links(t), "a long, b long")
    roots = components(links)
    named = written(classes.join(roots, classes.k1 == roots.node, "left").select("k1", "k2", "rep", F.coalesce("root", "k1").alias("root")), "named")
    least = written(named.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = written(named.join(least, "root").select("k1", "k2", "component"), "named")
    return info.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, t: float = NEAR) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; all columns as they were."""
    found = written(near_components(docs, t).where("doc_id <> component_id").select("doc_id"), "dropped")
    return without(docs, "doc_id", found)


def brute_components(texts: dict[int, str | None], t: float = NEAR) -> dict[int, tuple[int, int]]:
    """For tests: every pair compared. doc_id -> (n_shingles, component_id)."""
    import re

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {d: grams(x) for d, x in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(100 * t) * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}
