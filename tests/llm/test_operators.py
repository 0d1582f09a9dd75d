"""Each corpus operator against a brute-force version or an exact round trip, and on odd rows: nulls, empty and long texts, ties, repeated
rows, empty tables, more columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, decontaminate, fingerprints, html_blocks, jaccard, licenses, line_dedup, packing, quality, shards, warc
from gridloom.llm.common import NON_ALNUM, Texts, ranked, shingles
from gridloom.llm.graph import components
from gridloom.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_RNG = random.Random(3)
_WORDS = ["".join(_RNG.choices("abcdefghij", k=_RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices(_WORDS, k=n))


def edited(text, every):
    w = text.split()
    return " ".join("zz" if k % every == every - 1 else x for k, x in enumerate(w))


ITEM = prose(20, 900)
ROWS = [
    (1, prose(120, 1)), (2, prose(120, 1)), (3, edited(prose(120, 1), 60)), (4, edited(prose(120, 1), 9)), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, "One  TWO"), (10, prose(3000, 2) + " " + ITEM + " " + prose(2000, 3)), (11, " \n\t "),
    (12, prose(60, 4) + "\n" + prose(30, 5)), (13, prose(50, 6) + "\nReleased under the MIT License.\n" + prose(30, 5)), (14, "ééé ñ 中文 Σας 'S don't <|endoftext|> \U0001f600"), (15, ITEM.upper()), (15, ITEM.upper()), (None, prose(40, 7)), (16, "a"), (17, prose(4000, 8)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", 1.5, "k", 3) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, shard string, rank int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one two"), (5, prose(12, 901)), (6, ITEM)], "item_id long, text string")


def frame(df):
    return df.toPandas()


def test_words_and_shingles():
    text = ["A b-c", "", "ab  c\td", "é ÉX"]
    h, at, start = Texts(text).words(NON_ALNUM)
    assert np.diff(at).tolist() == [3, 0, 3, 2] and len(set(h.tolist())) == 7  # "c" stands in two texts
    s, first = shingles(*Texts(["a b c d e f", "a b c d e", "x", ""]).words()[:2])
    assert np.diff(first).tolist() == [2, 1, 1, 0] and s[0] == s[2]


def test_leaks(docs, benchmark):
    found = frame(decontaminate.find_leaks(docs, benchmark))
    pairs = sorted(zip(found.doc_id.astype(object), found.item_id))
    want = decontaminate.brute_leaks(pd.DataFrame(ROWS, columns=["doc_id", "text"]), frame(benchmark))
    assert set(pairs) == want and {(10, 1), (15, 6), (7, 4)} <= want and len(pairs) == len(want) + 2  # 15 stands twice
    assert len(found) == len(frame(decontaminate.find_leaks(docs, benchmark, block_items=1)))
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - len({d for d, _ in want}) - 1
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_shards(spark, docs):
    found = frame(shards.assign_shards(docs, 3))
    assert len(found) == len(ROWS)
    for r in found.itertuples():
        texts = [t for d, t in ROWS if d == r.doc_id or (d is None and pd.isna(r.doc_id))]
        assert any(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in texts)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert found[found.doc_id.isin([1, 2])].shard.nunique() == 1
    many = spark.createDataFrame([(k, prose(k % 30, k)) for k in range(400)] + [(k, "same text") for k in range(400, 700)], "doc_id long, text string")
    sizes = frame(shards.assign_shards(many, 8)).groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    assert shards.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert shards.assign_shards(docs.limit(0)).count() == 0


def test_shards_keep_groups_whole(spark):
    """A group between half and one fair share stays together."""
    rows = spark.createDataFrame([(k, prose(15, k)) for k in range(400)] + [(k, "same text") for k in range(400, 800)], "doc_id long, text string")
    found = frame(shards.assign_shards(rows, 8))
    share = found[found.doc_id >= 400]["size"].sum() / (found["size"].sum() / 8)
    assert 0.5 < share < 1 and found[found.doc_id >= 400].shard.nunique() == 1


def test_packing(docs):
    found = frame(packing.pack(docs, TOKENIZER))
    packing.check_packing(found)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for doc, own in found[found.doc_id.notna() & (found.doc_id != 15)].groupby("doc_id"):
        ids = np.array([*tokenizer.encode(dict(ROWS)[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 4096 or r.piece == len(own) - 1)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6.2, 1.1, 3000).astype(int) + 1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    runs, total = packing.plan(counts)
    assert total <= 1.01 * -(-lengths.sum() // 4096) + 1
    placed = sorted((length, rank) for length, first, n, *_ in runs for rank in range(first, first + n))
    assert placed == sorted((k, r) for k, n in counts.items() for r in range(n))


def test_encoder():
    from tokenizers import Tokenizer

    rng, own, other = random.Random(1), packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["".join(rng.choices("abXY 's'T \n.,_-<|>012²½ª×éßİĲΣσ中\x1c'\"”", k=rng.randint(0, 40))) for _ in range(3000)]
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(texts, add_special_tokens=False)]


def test_encoder_joins_new_words(monkeypatch):
    """New words are encoded many as one text; the ids are the tokenizer's, where words share a hash too, and where the cache overflows."""
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, own):
            self.own, self.asked = own, 0

        def encode_batch_fast(self, texts, **more):
            self.asked += len(texts)
            return self.own.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            return self.own.encode(text, **more)

    rng, other = random.Random(2), Tokenizer.from_file(TOKENIZER)
    texts = ["", " \n", "Don't they'll 'tis ''s _'re 'LL2'd", *("".join(rng.choices("abdelmrstvÉßȺ '.,_-\n09", k=rng.randint(0, 60))) for _ in range(1500))]
    right = [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(texts, add_special_tokens=False)]
    own = packing.Encoder(TOKENIZER)
    own.tokenizer = Counted(own.tokenizer)
    assert own.encode(texts) == right and len(own.cache) > 2000 and own.tokenizer.asked < len(own.cache) / 100
    assert packing.Encoder(TOKENIZER).encode([]) == [] and own.encode([*texts, "中"])[:-1] == right
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    assert [x for k in range(0, len(texts), 40) for x in own.encode(texts[k : k + 40])] == right
    monkeypatch.setattr(packing, "_MARK", np.ones_like(packing._MARK))
    assert own.encode(texts) == right


def test_encoder_holds_few_bytes_a_word(monkeypatch):
    """What a worker keeps of words is small, whatever it has read; words that share a hash with one that it keeps get their own ids."""
    import tracemalloc

    own, rng = packing.Encoder(TOKENIZER), random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1000)) for _ in range(20)]
    own.encode(["a b"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for text in texts:
        own.encode([text])
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(own.cache) > 19_000 and kept < 120 * len(own.cache)
    monkeypatch.setattr(packing, "_MARK", np.ones_like(packing._MARK))
    for text in ["ab cde", "ba cde", "edc ab", *texts[:2]]:
        assert own.encode([text]) == [own._whole(text)]


def test_slices_give_their_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "de", "f"])], names=["text"])
    assert [x.num_rows for x in common.chunks(batch, "text", 3)] == [2, 2] and len(given) == 2


def test_fingerprints(spark, docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = frame(fingerprints.fingerprint_documents(plain)).sort_values("doc_id").reset_index(drop=True)
    rows = sorted({d: t or "" for d, t in ROWS if d is not None}.items())
    assert found.doc_id.tolist() == [d for d, _ in rows]
    for k, (_, text) in enumerate(rows):
        half, following = len(text) // 2, rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - half] + following[:half]
        assert found.edited_sha256[k] == hashlib.sha256(changed.encode()).hexdigest() and found.n_chars[k] == len(text)
        assert found.near_edited[k] == fingerprints.likeness(found.fingerprint[k], found.edited_fingerprint[k])
    assert found.near_next[0] == 1.0 and found.fingerprint[0] == found.fingerprint[1] and found.near_edited.between(0, 1).all()
    assert fingerprints.fingerprint_documents(docs).count() == len(ROWS) and fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    assert fingerprints.fingerprint_documents(docs.where("doc_id = 16")).first()["near_next"] == 1.0


def test_fingerprints_tell_likeness(spark):
    vocabulary = ["".join(_RNG.choices("abcdefghijklmnop", k=8)) for _ in range(4000)]
    rows = [(k, " ".join(random.Random(k).choices(vocabulary, k=200))) for k in range(60)]
    found = frame(fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (found.near_edited > found.near_next).mean() > 0.95


def test_licenses(docs):
    found = frame(licenses.scan_licenses(docs))
    assert len(found) == len(ROWS)
    for r in found[found.doc_id.notna()].itertuples():
        text = dict(ROWS)[r.doc_id] or ""
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        if places:
            assert (r.first_word, r.last_word, r.base_labels, r.score) == (min(places)[0], max(places)[0], ",".join(sorted({x for _, x in places})), 1.0)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licence_join_is_exact(spark):
    rng = random.Random(5)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + _WORDS[:20]
    blocks = [" ".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(150)] + [t for _, t in licenses.TEMPLATES] + [" ".join(t.split()[1:]) for _, t in licenses.TEMPLATES]
    own = licenses.Templates(licenses.TEMPLATES, {}, 0.8)
    h, at, _ = Texts(["\n".join(blocks)]).words(NON_ALNUM)
    sizes = [len(b.split()) for b in blocks]
    found = {(b, t) for b, t, _ in own.join(h, np.repeat(np.arange(len(blocks)), sizes))}
    want = {(k, t) for k, b in enumerate(blocks) for t, (_, text) in enumerate(licenses.TEMPLATES) if len(set(text.split()) & set(b.split())) >= 0.8 * len(set(text.split())) - 1e-9}
    assert found == want and len(want) >= 2 * len(licenses.TEMPLATES) - 2


def labels_of(texts):
    own = licenses.Templates(licenses.TEMPLATES, {}, 0.8)
    return [set(filter(None, x.split(","))) for x in licenses.scan(pa.array(texts, pa.large_string()), own)["labels"]]


def test_licence_labels_of_one_block():
    """A template that meets a block keeps its label beside one that fits better; GPL-2 and GPL-3 are told by their numbers."""
    text = dict(reversed(licenses.TEMPLATES))
    mit, bsd = licenses.TEMPLATES[1][1], text["bsd"]
    assert labels_of([f"{mit} {bsd.removeprefix('redistribution ')}"]) == [{"mit", "bsd"}]
    assert labels_of([text[x] for x in ("gpl-2", "gpl-3", "lgpl", "cc-by")]) == [{"gpl-2"}, {"gpl-3"}, {"lgpl"}, {"cc-by"}]
    assert labels_of([f"{text['gpl-2']} {text['gpl-3']}", text["gpl-3"].removesuffix(" version 3")]) == [{"gpl-2", "gpl-3"}] * 2


@pytest.mark.parametrize("per_line", [3, 7, 12])
def test_wrapped_licences(per_line):
    """A notice wrapped over lines, as a comment too, is found as on one line; words that stand far apart are not."""
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + per_line]) for i in range(0, len(text.split()), per_line))
    for label, text in licenses.TEMPLATES:
        for mark in ("", " * ", "# "):
            found = labels_of([f"{prose(30, 1)}\n\n{wrap(text, mark)}\n\n{prose(30, 2)}", "\n".join(w + "\n" + prose(12, 3) for w in text.split())])
            assert label in found[0] and not found[1]


def test_licence_windows_are_exact():
    rng = random.Random(6)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = [" ".join(w for _ in range(6) for w in rng.choices(pool, k=rng.randint(0, 9)) + rng.choice(licenses.TEMPLATES)[1].split()[rng.randint(0, 4) :]) for _ in range(40)] + ["", "all rights"]
    own = licenses.Templates(licenses.TEMPLATES, {}, 0.8)
    h, at, _ = Texts(texts).words(NON_ALNUM)
    best: dict = {}
    for lo, hi, t, share in own.windows(h, at):
        k = int(np.searchsorted(at, lo, "right") - 1)
        assert at[k] <= lo < hi <= at[k + 1] and hi - lo <= own.width[t] and abs(np.isin(own.tokens[t], h[lo:hi]).mean() - share) < 1e-9
        best[k, t] = max(best.get((k, t), 0), share)
    want = {}
    for k in range(len(texts)):
        for t, tokens in enumerate(own.tokens):
            most = max((int(np.isin(tokens, h[max(at[k], i - own.width[t] + 1) : i + 1]).sum()) for i in range(at[k], at[k + 1])), default=0)
            if most >= own.need[t]:
                want[k, t] = most / len(tokens)
    assert best == want and len(want) > 50


def compare_components(df, rows, **how):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(df, **how).collect()}
    assert found == jaccard.brute_components(dict(rows))


def test_jaccard(spark, docs):
    own = [(d, t) for d, t in ROWS if d is not None and d != 15]
    compare_components(docs.where("doc_id is not null and doc_id <> 15"), own)
    assert jaccard.near_components(docs).count() == len(ROWS) and jaccard.near_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_first(docs.where("doc_id <> 15"))
    assert kept.columns == docs.columns and not {2, 3, 8, 9} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("most", [jaccard.MAX_ELEMENTS, 400])
def test_jaccard_clouds(spark, most):
    """Chains and clouds of near copies around the threshold, and passages that many texts share."""
    rng, rows, shared = random.Random(11), [], prose(30, 77)
    for g in range(6):
        text = prose(70, 1000 + g).split()
        for _ in range(14):
            text = [rng.choice(_WORDS) if rng.random() < 0.012 else w for w in text]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, shared + " " + prose(rng.randint(1, 60), 5000 + k)) for k in range(25)]
    compare_components(spark.createDataFrame(rows, "doc_id long, text string"), rows, max_elements=most)


def test_jaccard_links_over_rows_without_id(spark):
    """A is like B, B like C, A not like C; B has no doc_id."""
    w = prose(60, 31).split()
    a, c = ["x1", "x2", "x3", "x4", *w[4:]], [*w[:-4], "y1", "y2", "y3", "y4"]
    rows = [(1, " ".join(a)), (None, " ".join(w)), (3, " ".join(c)), (4, prose(30, 32))]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, None: 1, 3: 1, 4: 4}


def test_shards_of_one_id(spark):
    """A group larger than a share is spread though its rows have no doc_id; every slot is taken once."""
    rows = spark.createDataFrame([(None, "same text")] * 400 + [(k, prose(6, k)) for k in range(40)], "doc_id long, text string")
    found = frame(shards.assign_shards(rows, 4))
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() < 1.6 * sizes.mean() and all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_clashing_columns(spark):
    """Names that the operators use for themselves may be the table's own."""
    rows = [(k, prose(40, k % 3), "b", "d", "t", 0.5) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bucket string, _drop string, _th string, _quality double")
    assert jaccard.keep_first(df).columns == df.columns and jaccard.keep_first(df).count() == 3
    assert line_dedup.drop_repeated(df).columns == df.columns and line_dedup.drop_repeated(df).count() == 3
    assert quality.keep_good(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).columns == df.columns


def test_warc_size_classes(spark, tmp_path):
    """Records of all sizes come back; a file holds no more bytes than asked, unless by one record."""
    rows = [(k, "u", "x" * n + str(k)) for k, n in enumerate((0, 10, 70_000, 70_000, 300_000, 1_200_000, 5))]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), file_bytes=200_000)
    found = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, path).collect()}
    assert found == {k: len(h) for k, _, h in rows}
    assert sorted(p.stat().st_size > 200_000 for p in (tmp_path / "w").rglob("part-*")).count(True) <= 2


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 9), (20, 21), (21, 22), (11, 10)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(500)], "g long, v long")
    found = frame(ranked(df, ["g"], ["v"], 500, per_salt=1))
    assert all(sorted(x["rank"]) == list(range(len(x))) for _, x in found.groupby("g"))


def test_line_dedup(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs far away", "another quite different line of words stands here"
    rows = [(0, a + "\nshort"), (1, a.upper() + "!\n" + b), (2, a.replace("dog", "cat") + "\nunique line number one of this text\nshort"), (3, None), (4, ""), (None, a), (5, a + "\n" + b), (6, a + "\n" + a), (6, a + "\n" + a)]
    df = spark.createDataFrame([(d, t, 1, None if t is None else len(t)) for d, t in rows], "doc_id long, text string, line int, n_chars long")
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()]
    by = dict((x[0], x[1:]) for x in found)
    assert by[0] == (a + "\nshort", 2, 0) and by[1] == (b, 2, 1) and by[3] == (None, 0, 0) and by[4] == ("", 1, 0) and by[None][0] == a and by[5] == ("", 2, 2) and by[6] == ("", 2, 2)
    assert by[2] in (("unique line number one of this text\nshort", 3, 1), (rows[2][1], 3, 0))
    kept = {r["doc_id"]: r for r in line_dedup.drop_repeated(df).collect()}
    assert set(kept) == {0, 1, 2, 3, 4, None} and kept[1]["n_chars"] == len(b) and line_dedup.drop_repeated(df).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def word_edits(x, y):
    row = list(range(len(y) + 1))
    for p, u in enumerate(x):
        last, row = row, [p + 1]
        for q, v in enumerate(y):
            row.append(min(last[q] + (u != v), last[q + 1] + 1, row[q] + 1))
    return row[-1]


def test_line_dedup_recall(spark):
    """Pairs by length and edits (other words, words that go, words that come), up to the limit: nearly all are found, in each cell."""
    cells = [(n, e, kind) for n in (5, 10, 20, 30, 60, 120) for e in sorted({1, n // 10, n // 5} - {0}) for kind in ("change", "spread", "mixed")]
    rows, where = [], {}
    for c, (n, e, kind) in enumerate(cells):
        for k in range(60):
            rng = random.Random(1000 * c + k)
            own = ["".join(rng.choices("abcdefghijklmnopqrs", k=rng.randint(2, 9))) for _ in range(n)]
            w, places = list(own), list(range(0, n, max(1, n // e)))[:e] if kind == "spread" else rng.sample(range(n), e)
            for i in sorted(places, reverse=True):
                how = rng.randrange(3) if kind == "mixed" and n > 5 else 0
                w[i : i + 1] = [["changed" + str(rng.random())[2:9]], [], [w[i], "new" + str(rng.randint(0, 99))]][how]
            if len(w) < 5 or word_edits(own, w) > 0.2 * max(len(own), len(w)) + 1e-9:
                continue
            where.setdefault((n, e, kind), []).append(len(rows) + 1)
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(w))]
    found = frame(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))).set_index("doc_id").n_dropped
    recall = {cell: float(np.mean([found[d] for d in own])) for cell, own in where.items()}
    assert sum(found[d] for d in range(0, len(rows), 2)) == 0 and len(recall) > 40
    assert min(recall.values()) >= 0.9 and np.mean(list(recall.values())) > 0.995


def test_line_dedup_is_exact(spark, monkeypatch):
    """Against all pairs compared, around the threshold; frequent words and few lines make a key hot, so that both pigeonholes are met."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    monkeypatch.setattr(line_dedup, "KEYS", 1000)
    rng, texts = random.Random(17), []
    for k in range(30):
        n = (5, 8, 14, 30, 60)[k % 5]
        base = rng.choices(_WORDS[: (12, 400)[k % 2]], k=n)
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, n // 5 + 1)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choices(_WORDS, k=rng.randint(0, 1)) if len(w) > 5 else rng.choices(_WORDS, k=1)
            texts.append(w)
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for j, y in enumerate(texts):
        for i, x in enumerate(texts[:j]):
            if x == y or (min(len(x), len(y)) >= 5 and word_edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = frame(line_dedup.dedup_lines(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")))
    assert set(found[found.n_dropped == 0].doc_id) == {k for k in range(len(texts)) if top(k) == k}


def test_line_dedup_connects_a_group_before_all_pairs(spark, monkeypatch):
    """Of near copies, many are unlike their hub; when all lines of a region meet, few of them are not yet connected, so few pairs are made."""
    rng, rows, made = random.Random(5), [], []
    base = [f"word{k}" for k in range(40)]
    for d in range(300):
        own = list(base)
        for i in rng.sample(range(40), rng.randint(3, 5) if d else 5):
            own[i] = f"other{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    others = line_dedup._others

    def counted(star, parts, codes, names, similarity):
        name = {r["node"]: r["root"] for r in names.collect()}
        own = [(r["like"], name.get(r["lh"], r["lh"])) for r in star.collect()]
        made.append(sum(x != y for like, x in own if not like for _, y in own))
        return others(star, parts, codes, names, similarity)

    monkeypatch.setattr(line_dedup, "_others", counted)
    lines = spark.createDataFrame(rows, "lh long, norm string").coalesce(1)
    found = frame(line_dedup._links(lines.select(F.lit(0).cast("long").alias("region"), "lh"), lines, 0.8))
    assert set(found.node) == set(range(len(rows))) and set(found.root) == {0}
    assert len(made) == 1 and made[0] < 4 * len(rows)


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Every table that the operator writes, and its result, come from DataFrame operations; near copies that differ from their hub meet."""
    plans, put = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df, *a, **b))[1])
    base = [f"word{k}" for k in range(20)]
    lines = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 20, 4)] + ["Ünlike — línes, of\u00a0five words!", "ünlike línes of five WORDS"]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.where("n_dropped = 0").collect()} == {0, 5}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "InArrow" in p or "InPandas" in p or "PythonUDF" in p or "EvalPython" in p]


def test_line_dedup_deals_keys_and_reads_texts_once(spark, monkeypatch):
    """Keys are written only after they were counted, made one a line and compared by length; a text passes one regular expression."""
    plans, put = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *a, **b: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), put(df, name, *a, **b))[1])
    lines = ["one of the lines that are like each other here", "one of the lines that are like each other there", "ünlike – línes of other wörds"]
    found = line_dedup._measured(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), 0.8, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [r["n"] for r in found.orderBy("doc_id").collect()] == [10, 10, 5]
    assert line_dedup._regions(found, 0.8).count() == 2
    assert [name for name, _ in plans] == ["members", "members", "regions"]


def test_line_dedup_hashes_first_blocks_only(spark, monkeypatch):
    """The keys of a line are the first of its blocks in one order, whatever words are repeated; words tell which can be, and no others are
    hashed. Places are read where lines were written; texts that stay whole are not taken apart."""
    rng = random.Random(5)
    lines = [" ".join(rng.choices(_WORDS[:most], k=n)) for n in (5, 9, 20, 24, 60, 300) for most in (2, 9, 400)]
    docs = spark.createDataFrame([(k, f"{x}\n - \na b") for k, x in enumerate(lines)], "doc_id long, text string")
    measured = line_dedup._measured(docs, 0.8, 5)
    assert "<= last#" in measured._jdf.queryExecution().optimizedPlan().toString()
    first = {r["doc_id"]: r for r in measured.where("line = 0").collect()}
    monkeypatch.setattr(line_dedup, "KEYS", 1000)
    monkeypatch.setattr(line_dedup, "SHARED", 1000)
    every = {r["doc_id"]: r["keys"] for r in line_dedup._measured(docs, 0.8, 5).where("line = 0").collect()}
    monkeypatch.undo()
    for d, line in enumerate(lines):
        w = line.split()
        around = w + w[:2]
        assert first[d]["n"] == len(w) and len(every[d]) == len({tuple(around[i : i + 3]) for i in range(len(w))}) and every[d] == sorted(every[d])
        assert first[d]["keys"] == every[d][: len(first[d]["keys"])]
        if len(every[d]) == len(w):
            assert len(first[d]["keys"]) == min(14, int(0.6 * len(w) + 1e-9) + 2)
    assert {(r["line"], r["n"], r["lh"], len(r["keys"])) for r in measured.where("line > 0").collect()} == {(1, 0, None, 0), (2, 2, None, 0)}
    names, put = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *a, **b: (names.append(name), put(df, name, *a, **b))[1])
    out = line_dedup.dedup_lines(docs.union(docs))
    assert "lines" in names and "places" not in names
    assert {(r["n_lines"], r["n_dropped"]) for r in out.collect()} == {(3, 0)} and out.where("text like '%\n - \na b'").count() == 2 * len(lines)


def test_line_dedup_reads_names_once(spark, monkeypatch):
    """What goes is told by one order of the places of each name, without a join; repeated rows have one place."""
    plans, put = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *a, **b: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), put(df, name, *a, **b))[1])
    line = "one of the lines that stand several times"
    rows = [(3, line), (2, f"own\n{line}\n{line}"), (2, f"own\n{line}\n{line}"), (2, f"{line} x\n{line}"), (4, "a line of its own that stays")]
    gone = {(r["doc_id"], r["th"]): sorted(r["drop"]) for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((d, x) for (d, _), x in gone.items()) == [(2, [1]), (2, [1, 2]), (3, [0])]
    assert "Join" not in plans["gone"] and plans["gone"].count("Window") == 1


def test_region_links():
    """Against all pairs compared: short and long lines, few different words and many."""
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert line_dedup.edits(a, b) == word_edits(a, b)
    for t in range(12):
        lines = []
        for _ in range(8):
            base = [rng.randrange(2**32 if t % 2 else 40) for _ in range(rng.choice((5, 6, 10, 25, 80)))]
            for _ in range(4):
                w = list(base)
                for _ in range(rng.randint(0, len(w) // 5 + 1)):
                    w[rng.randrange(len(w))] = rng.randrange(2**32)
                lines.append(w)
        names = np.arange(len(lines), dtype=np.int64)

        def classes(links, n=len(lines)):
            root = list(range(n))
            for a, b in links:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
            return root

        like = [(i, j) for j in range(len(lines)) for i in range(j) if word_edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9]
        assert classes(line_dedup.region_links(names, names, [np.array(w, "<u4") for w in lines], 0.8)) == classes(like)


def test_links_of_many_regions(monkeypatch):
    """Regions compared many at a time, or one by one, have the links of all pairs compared."""
    rng, rows = random.Random(3), []
    for r in range(40):
        bases = [[rng.randrange(2**32 if r % 2 else 40) for _ in range(rng.choice((5, 6, 10, 25, 80)))] for _ in range(3)]
        for k in range(rng.randint(1, 14)):
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, len(w) // 5 + 1)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [rng.randrange(2**32)] * rng.randint(0, 1) or [1]
            rows.append((r, 100 * k + r, w))
    region, names, n = (np.array(x) for x in ([x[0] for x in rows], [x[1] for x in rows], [len(x[2]) for x in rows]))

    def classes(links):
        root = {x[1]: x[1] for x in rows}
        for a, b in links:
            least, both = min(root[a], root[b]), (root[a], root[b])
            root = {x: least if y in both else y for x, y in root.items()}
        return root

    like = [(x[1], y[1]) for k, x in enumerate(rows) for y in rows[:k] if x[0] == y[0] and word_edits(x[2], y[2]) <= 0.2 * max(len(x[2]), len(y[2])) + 1e-9]
    for small in (128, 4):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        links = line_dedup.all_links(region, names, names, np.concatenate([np.array(x[2], "<u4") for x in rows]), n, 0.8)
        assert classes(links) == classes(like) and len(links) == len(rows) - len(set(classes(like).values()))


def test_components_carry_few_rows(spark, monkeypatch):
    """Nodes that have met are carried no further: the rows written for a long chain are a small multiple of its nodes."""
    from gridloom.llm import graph

    rows, order = [], random.Random(5).sample(range(300), 300)
    monkeypatch.setattr(graph, "written", lambda df, name, put=graph.written: (out := put(df, name), rows.append(out.count()))[0])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()}
    assert found == dict.fromkeys(range(300), 0) and sum(rows) < 10 * 300


def test_short_lines(spark):
    """Equal lines of few words, or without spaces, are found too."""
    rows = [(k, f"All rights reserved.\n{line}") for k, line in enumerate(("一二三四五六七八九十", "一二三四五六七八九十", "own line"))]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: rows[0][1], 1: "", 2: "own line"}


def test_extract(spark):
    rng = random.Random(123)
    pages = [html_blocks.page_maker(rng) for _ in range(80)]
    rows = [(k, "u", h, "x") for k, (h, _) in enumerate(pages)] + [(1000, None, None, "x"), (1001, "u", "", "x"), (1002, "u", "<p>unclosed <b", "x"), (1003, "u", "<" * 5000 + "\"'" * 5000, "x")]
    found = {r["page_id"]: r for r in html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    right = sum(found[k]["text"] == "\n".join(m) for k, (_, m) in enumerate(pages))
    assert len(found) == len(rows) and right >= 0.85 * len(pages)
    assert found[1000]["text"] == "" and found[1001]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_leaves():
    found = html_blocks.leaves("<head><title>t</title></head><nav><a href='>'>x</a></nav><script>var a='</p>';</script><p>a &amp; b<p>c <i>d</i>e<br>f<br><br>g<!-- no --><ul><li>h<li>i</ul>tail")
    assert [x.text for x in found] == ["x", "a & b", "c de f", "g", "h", "i", "tail"] and found[0].link == 1.0 and found[4].path == ("ul", "li")


def test_network_gradients():
    net, rng = html_blocks.Network(1), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(4, 3, html_blocks.WIDTH)) * 0.3, np.ones((4, 3)), (rng.random((4, 3)) > 0.5).astype(float)
    mask[3, 0] = 0
    g, _ = net.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, losses = net.p[k][at], []
        for d in (1e-4, -1e-4):
            net.p[k][at] = old + d
            losses.append(net.gradients(x, mask, y)[1])
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - g[k][at]) < 1e-3


def test_quality(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = frame(quality.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels))
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(found.doc_id, found.held_out))
    own = frame(labels).merge(found, on="doc_id")
    assert (own[own.held_out].predicted == own[own.held_out].quality).mean() > 0.85
    odd = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    out = frame(quality.score_documents(docs, odd))
    assert len(out) == len(ROWS) and out.score.between(0, 1).all()
    assert (frame(quality.score_documents(docs, odd.limit(0))).score == 0.5).all()
    assert quality.score_documents(docs.limit(0), odd).count() == 0
    kept = quality.keep_good(docs, odd)
    assert kept.columns == docs.columns


def test_trees_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    assert ((quality.fit(x[:1000], y[:1000]).score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.93


def test_warc(spark):
    inside = "x" * 60 + "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é" * 60
    rows = [(3, "u", inside), (1, None, inside), (2, "a b\r\n", None), (4, "q", "small"), (5, "q", "small"), (None, "q", inside), (1, None, inside)]
    found = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = len(inside.encode())
    assert found == {(3, "revisit", 1, n, sha(inside)), (1, "response", None, n, sha(inside)), (None, "revisit", 1, n, sha(inside)), (2, "response", None, 0, sha("")), (4, "response", None, 5, sha("small")), (5, "response", None, 5, sha("small"))}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_chain():
    record = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    data = record(b"a") + record(record(b"inner") * 3) + record(b"")
    at, after = warc.candidates(data)
    assert len(at) == 6 and warc.reachable(at, after, len(data)).sum() == 3
    with pytest.raises(ValueError):
        warc.reachable(*warc.candidates(data[:-1]), len(data) - 1)
    assert warc.reachable(*warc.candidates(b""), 0).sum() == 0


def test_queries_are_registered():
    assert [re.match(r"op\d+", k)[0] for k in QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_stages_on_odd_rows(spark, docs, benchmark, tmp_path):
    import corpus_pipeline

    frames = {"benchmark": benchmark, "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), "documents": docs.withColumn("n_chars", F.length("text").cast("long"))}
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = frame(corpus_pipeline.run(spark, str(tmp_path)))
    packing.check_packing(out)
    assert {3, 2, 10, 15} & set(out.doc_id.dropna()) == set()
