"""Best-fit packing by exact-complement hashing.

Documents become token ids; each is followed by id 1; only those of more than CAPACITY are cut. Packing works on the
lengths alone: a table of how many pieces have each of at most 4096 lengths, so what the driver plans is bounded
however many pieces there are. From the longest length down, what is missing to a full sequence is looked up in an
index of single lengths, of sums of two and of sums of three; a combination is consumed as often as the counts allow.
What remains is packed by best fit, again in bulk: into the gap goes the longest length left that fits.

The plan is a list of runs (length, first rank, pieces, first sequence, pieces a sequence, offset): the pieces of a
length, ranked, are dealt to the sequences by arithmetic, found by binary search in the runs.

Defined cases: a null text counts as empty and is the single token 1; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, powers, ranked, written

CAPACITY = 4096
END = 1
CACHE_WORDS = 600_000
#: How many new words are encoded as one text, and what the tokens that end a word end with.
JOINED = 256
_LAST = "</w>"
#: Words that repeat in so many bytes are looked up once; what a worker needs besides is some hundred times that.
TEXT_BYTES = 1 << 20
#: Where splitting into words and encoding each gives what encoding the whole text gives: Latin letters, printable ASCII.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]|<\\|")
_STRANGE = np.array([bool(_OTHER.search(chr(c))) for c in range(0x251)])
#: The tokenizer's own split, where no other characters stand.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What such characters are, in lower case too, as the split takes them.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.array([_SPACE if c.isspace() else _LETTER if re.match(r"[^\W\d_]", c) else _DIGIT if re.match(r"\d", c) else _SIGN for c in map(chr, range(0x3000))], np.uint8)
#: A number for each character; words are told apart by sums of these, each times a power, and compared in full.
_MARK = np.random.default_rng(20250301).integers(1, 2**63, len(_KIND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _starts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a lower-cased text (its code points) start and end, as _WORD finds them."""
    kind = _KIND[text]
    inside = kind != _SPACE
    other = kind[1:] != kind[:-1]
    start = inside.copy()
    start[1:] &= other | (kind[1:] == _DIGIT)
    # 's, 't and so on, where no sign stands before: two characters, or three, are one word, and letters after it start another.
    tick = np.flatnonzero((text[:-1] == ord("'")) & start[:-1])
    if len(tick):
        after = np.concatenate([text, np.zeros(2, text.dtype)])
        one, two = after[tick + 1], after[tick + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        size = np.where(is_(one, "stmd"), 2, np.where(((two == ord("e")) & is_(one, "rv")) | ((two == ord("l")) & (one == ord("l"))), 3, 0))
        tick, size = tick[size > 0], size[size > 0]
        start[tick + 1] = False
        ends = tick + size
        ends = ends[ends < len(text)]
        start[ends] = inside[ends]
    at = np.flatnonzero(start)
    # A word ends where the next one starts, or at white space.
    gap = np.flatnonzero(np.concatenate([~inside, [True]]))
    return at, np.minimum(np.concatenate([at[1:], [len(text)]]), gap[np.searchsorted(gap, at)])


def _within(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first + 0, first + 1 ... of each run of n."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Words and their token ids in a few arrays: tens of bytes a word, which as Python objects takes hundreds. Hashes rise; characters and ids
    stand in the order in which words came."""

    def __init__(self, hashed: np.ndarray, n: np.ndarray, chars: np.ndarray, size: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None, ids_at: np.ndarray | None = None):
        self.hashed, self.n, self.chars, self.size, self.ids = hashed, n.astype(np.int32), chars.astype(np.uint16), size.astype(np.int32), ids.astype("<u4")
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n if at is None else at
        self.ids_at = np.cumsum(self.size, dtype=np.int64) - self.size if ids_at is None else ids_at

    def __len__(self) -> int:
        return len(self.hashed)

    def find(self, hashed: np.ndarray, n: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray | None:
        """The place of each word here, or -1; None if another word here has the hash of one."""
        if not len(self):
            return np.full(len(hashed), -1)
        place = np.minimum(np.searchsorted(self.hashed, hashed), len(self) - 1)
        there = self.hashed[place] == hashed
        own = place[there]
        if (self.n[own] != n[there]).any() or (self.chars[_within(self.at[own], self.n[own])] != text[_within(at[there], n[there])]).any():
            return None
        return np.where(there, place, -1)

    def ids_of(self, place: np.ndarray) -> np.ndarray:
        return self.ids[_within(self.ids_at[place], self.size[place])]

    def with_more(self, other: Words) -> Words:
        """Both; no word stands in either twice."""
        to = np.searchsorted(self.hashed, other.hashed)
        both, merged = lambda x, y: np.concatenate([x, y]), lambda x, y: np.insert(x, to, y)
        at, ids_at = merged(self.at, other.at + len(self.chars)), merged(self.ids_at, other.ids_at + len(self.ids))
        return Words(merged(self.hashed, other.hashed), merged(self.n, other.n), both(self.chars, other.chars), merged(self.size, other.size), both(self.ids, other.ids), at, ids_at)


def _no_words() -> Words:
    return Words(*[np.zeros(0, t) for t in (np.uint64, np.int32, np.uint16, np.int32, "<u4")])


class Encoder:
    """Texts to token ids (little-endian unsigned 32-bit), encoding each distinct word once as long as the cache has room."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _no_words()
        vocab = self.tokenizer.get_vocab()
        #: Whether a token ends a word. If every byte has one that does, each word has one such token, its last.
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for w, k in vocab.items() if w.endswith(_LAST)]] = True
        self.joins = sum(len(w) == 1 + len(_LAST) and w.endswith(_LAST) for w in vocab) == 256

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words, which are encoded together, many as one text."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)] if self.joins else [[w] for w in words]
        out: list[bytes] = []
        for k in range(0, len(groups), JOINED):  # what the tokenizer returns takes many times what is kept of it
            part = groups[k : k + JOINED]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(group) == 1 or len(ends) != len(group):
                    out += map(self._whole, group)
                    continue
                own = ids.tobytes()
                out += [own[i:j] for i, j in zip([0, *ends], ends)]
        return out

    def _ids(self, hashed: np.ndarray, n: np.ndarray, at: np.ndarray, text: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words, one after another, how many each has); hashes rise."""
        place = self.cache.find(hashed, n, at, text)
        if place is None:  # a word that the cache has shares its hash with another: nothing of it is used
            self.cache, place = _no_words(), np.full(len(hashed), -1)
        new = np.flatnonzero(place < 0)
        if len(self.cache) + len(new) > CACHE_WORDS or len(self.cache.chars) > 16 * CACHE_WORDS:
            self.cache, new = _no_words(), np.arange(len(hashed))
        if len(new):
            found = self._learn([joined[i:j] for i, j in zip(at[new].tolist(), (at[new] + n[new]).tolist())])
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            more = Words(hashed[new], n[new], text[_within(at[new], n[new])], size, np.frombuffer(b"".join(found), "<u4"))
            self.cache = self.cache.with_more(more) if len(self.cache) else more
            place = np.searchsorted(self.cache.hashed, hashed)
        return self.cache.ids_of(place), self.cache.size[place].astype(np.int64)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts of characters whose words can be encoded one by one."""
        lower = [t.lower() for t in texts]
        joined = "\n".join(lower)
        text = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        at, ends = _starts(text)
        n = ends - at
        scale, back = powers(len(text))
        with np.errstate(over="ignore"):
            total = np.zeros(len(text) + 1, np.uint64)
            np.multiply(_MARK[text], scale, out=total[1:])
            np.cumsum(total, out=total)
            hashed = (total[ends] - total[at]) * back[at] if len(at) else total[:0]
        del total
        hashed, first, word = np.unique(hashed, return_index=True, return_inverse=True)
        same = first[word]
        if (n[same] != n).any() or (text[_within(at[same], n)] != text[_within(at, n)]).any():  # two words share a hash
            names = [joined[i:j] for i, j in zip(at.tolist(), ends.tolist())]
            own: dict[str, int] = {}
            word = np.array([own.setdefault(w, len(own)) for w in names], np.int64)
            found = self._learn(list(own))
            ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        else:
            ids, size = self._ids(hashed, n[first], at[first], text, joined)
        every = ids[_within((np.cumsum(size) - size)[word], size[word])]
        # Texts end after so many characters, words and ids.
        chars = np.cumsum([0] + [len(t) + 1 for t in lower])
        cut = np.concatenate([[0], np.cumsum(size[word])])[np.searchsorted(at, chars)].tolist()
        return [every[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not _STRANGE[np.minimum(chars, len(_STRANGE) - 1)].any() and "<|" not in joined and unicodedata.is_normalized("NFC", joined):
            return self._plain(texts)
        plain = [not _OTHER.search(t) and unicodedata.is_normalized("NFC", t) for t in texts]
        found = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        return [next(found) if p else self._whole(t) for t, p in zip(texts, plain)]


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which may serve many tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents as token sequences, cut where they are longer than the capacity."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.encode([t or "" for t in part["text"].to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        for to, value in zip(out, (doc, k, start, len(own) // 4, zlib.crc32(own))):
                            to.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) that place every piece, and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int, int]] = []
    total = 0

    def take(lengths: list[int]) -> None:
        """The combination, as often as it can be had."""
        nonlocal total
        own, many = np.unique(np.array(lengths), return_counts=True)
        times = int((left[own] // many).min())
        offset = 0
        for length, k in sorted(zip(own.tolist(), many.tolist()), reverse=True):
            runs.append((length, int(used[length]), times * k, total, k, offset))
            used[length] += times * k
            left[length] -= times * k
            offset += length * k
        total += times

    if left[capacity]:
        take([capacity])
    two = np.zeros(capacity + 1, bool)

    def index() -> None:
        """two[s]: some pair of lengths adds up to s. Counts only fall, so a sum that has none is settled; the others may be out of date."""
        have = left > 0
        two[:] = False
        for a in np.flatnonzero(have):
            two[a : capacity + 1] |= have[: capacity + 1 - a]

    index()

    def enough(combination: list[int]) -> bool:
        own, many = np.unique(np.array(combination), return_counts=True)
        return bool((left[own] >= many).all())

    def exact(first: int) -> list[int] | None:
        gap = capacity - first
        if enough([first, gap]):
            return [first, gap]
        if two[gap]:
            a = np.arange((gap + 1) // 2, gap)
            for x in a[(left[a] > 0) & (left[gap - a] > 0)]:
                if enough([first, int(x), int(gap - x)]):
                    return [first, int(x), int(gap - x)]
        a = np.flatnonzero(left[:gap] > 0)[::-1]
        tried = a[two[gap - a]]
        for x in tried:
            rest = gap - int(x)
            b = np.arange((rest + 1) // 2, rest)
            for y in b[(left[b] > 0) & (left[rest - b] > 0)]:
                if enough(c := [first, int(x), int(y), int(rest - y)]):
                    return c
        if len(tried) > 200:  # the index misled: it is made anew
            index()
        return None

    for first in range(capacity - 1, 0, -1):
        while left[first] and (combination := exact(first)):
            take(combination)
    while (rest := np.flatnonzero(left)).size:  # best fit: the longest that is left, then always the longest that fits
        combination, gap, free = [int(rest[-1])], capacity - int(rest[-1]), left.copy()
        free[rest[-1]] -= 1
        while gap and (fit := np.flatnonzero(free[: gap + 1])).size:
            length = int(fit[-1])
            k = int(min(free[length], gap // length))
            combination += [length] * k
            free[length] -= k
            gap -= k * length
        take(combination)
    return runs, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, each with its sequence_id and offset."""
    spark = docs.sparkSession
    found = written(pieces(docs, tokenizer, capacity))
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((table[:, 0] << np.int64(48) | table[:, 1], table))
    numbered = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "_rank")

    def place(frames):
        keys, runs = shared.value
        for x in frames:
            length, rank = x["length"].to_numpy(np.int64), x["_rank"].to_numpy(np.int64)
            r = runs[np.searchsorted(keys, length << np.int64(48) | rank, "right") - 1] if len(runs) else runs
            i = rank - r[:, 1]
            x = x.drop(columns="_rank")
            x["sequence_id"], x["offset"] = r[:, 3] + i // r[:, 4], r[:, 5] + i % r[:, 4] * length
            yield x

    return numbered.select(*found.columns, "_rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def check_packing(rows: pd.DataFrame, capacity: int = CAPACITY) -> None:
    """For tests: every sequence is filled without gaps or overlaps, and to the capacity at most."""
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        ends = (s["offset"] + s["length"]).tolist()
        assert [0, *ends[:-1]] == s["offset"].tolist() and ends[-1] <= capacity
