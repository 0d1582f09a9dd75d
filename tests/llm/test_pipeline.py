"""Each stage of the pipeline against a brute-force version of itself on the stage's own input."""

import unicodedata

import pytest

import corpus_pipeline
from gridloom.llm import decontaminate, jaccard, packing, quality
from gridloom.llm.common import read, written


def words(line):
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line.lower()).split()


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = read(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), name)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(list(after.columns) == list(before.columns) for before, after in steps[:-1])


def test_quality(spark, sf_dir, steps):
    before, after = steps[0]
    scored = quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).toPandas()
    assert set(after.doc_id) == set(scored[scored.predicted == 1].doc_id)
    labels = read(spark, sf_dir, "labels").toPandas()
    good, bad = (set(labels[labels.quality == k].doc_id) for k in (1, 0))
    kept = set(after.doc_id)
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_lines(steps):
    before, after = steps[1]
    first, last = {}, {}
    for d, text in sorted(zip(before.doc_id, before.text)):
        for k, line in enumerate((text or "").split("\n")):
            if len(w := words(line)) >= 5:
                first.setdefault(tuple(w), (d, k))
    for d, text in zip(after.doc_id, after.text):
        own = [tuple(words(x)) for x in (text or "").split("\n")]
        for w in own:
            if len(w) >= 5:
                assert w not in last, "a line is left twice"
                last[w] = d
    # Every distinct line is left where it stood first, or a like one is; those that went without a like one would be lost.
    assert all(first[w][0] == d for w, d in last.items()) and len(last) >= 0.9 * len(first)
    texts = dict(zip(before.doc_id, before.text))
    for d, text in zip(after.doc_id, after.text):
        rest = iter(texts[d].split("\n"))
        assert all(line in rest for line in text.split("\n"))  # lines that stay keep their order


def test_near_duplicates(steps):
    before, after = steps[2]
    want = jaccard.brute_components(dict(zip(before.doc_id, before.text)))
    assert set(after.doc_id) == {d for d, (_, c) in want.items() if c == d}


def test_decontamination(spark, sf_dir, steps):
    before, after = steps[3]
    leaks = decontaminate.brute_leaks(before, read(spark, sf_dir, "benchmark").toPandas())
    assert set(after.doc_id) == set(before.doc_id) - {d for d, _ in leaks}


def test_packing(steps):
    before, after = steps[4]
    packing.check_packing(after)
    assert set(after.doc_id) == set(before.doc_id) and after.sequence_id.nunique() <= -(-after.length.sum() // packing.CAPACITY) + 1
