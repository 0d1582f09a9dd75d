"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A block is a line, or any run of as many words as the template has over the threshold (a notice wrapped over lines, with up to a
quarter of other words between), wherever it starts and over the ends of lines. A template's tokens are its distinct words, put into one global order: rarest first by document frequency over
all texts, ties by hash. A block meets a template when |block & template| >= t * |template|. With need = ceil(t * |template|), a block
that meets it has one of the template's first |template| - need + 1 tokens (prefix filter) and at least `need` distinct words (length
filter); and if the first one it has stands at place p, at most |template| - p are shared (positional filter). What passes is counted
exactly. Every pair that meets gives its label. Only of notices that share nearly all words (GPL-2 and GPL-3, GPL and LGPL, CC BY and CC BY-NC) one is
left out where the words that tell it from the other are missing and the other's are there. Beside the join, fixed phrases are found word by word wherever they stand, over the ends of lines too.

Defined cases: a null text counts as empty; texts without words have no places and score 0; repeated rows give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NEAR, NON_ALNUM, Texts, chunks

# The phrases and labels of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short forms of public licence notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "all rights reserved"),
]


def _hashes(text: str) -> np.ndarray:
    return Texts(pa.array([text], pa.large_string())).words(NON_ALNUM)[0]


class Templates:
    """The templates as token sets under the global order, ready to be joined with blocks."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[int, int], threshold: float):
        self.labels, self.tokens, self.need, self.width = [], [], [], []
        for label, text in templates:
            own = sorted({int(x) for x in _hashes(text)}, key=lambda x: (frequency.get(x, 0), x))
            self.labels.append(label)
            self.tokens.append(np.array(own, np.uint64))
            self.need.append(max(1, math.ceil(threshold * len(own) - 1e-9)))
            self.width.append(math.ceil(len(_hashes(text)) / threshold - 1e-9))
        pairs = sorted((int(x), t, p) for t, own in enumerate(self.tokens) for p, x in enumerate(own[: len(own) - self.need[t] + 1]))
        self.prefix = np.array([x for x, _, _ in pairs], np.uint64)
        self.to = np.array([(t, p) for _, t, p in pairs], np.int64).reshape(-1, 2)
        # Templates of other labels whose whole text meets this one too, if words of this one are missing there: (other, these words, words of the other only).
        self.rivals: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for t, a in enumerate(self.tokens):
            near = [o for o, b in enumerate(self.tokens) if self.labels[o] != self.labels[t] and self.need[t] <= len(np.intersect1d(a, b)) < len(a)]
            self.rivals.append([(o, np.setdiff1d(a, self.tokens[o]), np.setdiff1d(self.tokens[o], a)) for o in near])

    def windows(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, end, template, containment) for every run of `width` words of a text (at: first word of each text and the end)
        that meets a template. Each run is counted: a token stands in those that end from its place to before its next one."""
        out = []
        for t, (tokens, need) in enumerate(zip(self.tokens, self.need)):
            hit = np.flatnonzero(np.isin(h, tokens))
            rare = hit[np.isin(h[hit], tokens[: len(tokens) - need + 1])]  # prefix
            if not len(rare):
                continue
            width = self.width[t]
            k = np.searchsorted(rare, hit)
            hit = hit[np.minimum(np.abs(rare[np.minimum(k, len(rare) - 1)] - hit), np.abs(rare[np.maximum(k - 1, 0)] - hit)) < width]
            text = np.searchsorted(at, hit, "right") - 1
            hit, text = (x[np.bincount(text, minlength=len(at))[text] >= need] for x in (hit, text))  # length
            if not len(hit):
                continue
            order = np.lexsort((hit, h[hit]))
            follows = np.full(len(hit), len(h))
            follows[order[:-1]] = np.where(h[hit[order[:-1]]] == h[hit[order[1:]]], hit[order[1:]], len(h))
            end = np.minimum(np.minimum(follows, hit + width), at[text + 1])
            place = np.unique(np.concatenate([hit, end]))
            step = np.bincount(np.searchsorted(place, hit), minlength=len(place)) - np.bincount(np.searchsorted(place, end), minlength=len(place))
            have = np.cumsum(step)
            # Counts change only at these places, so between two of them all runs are alike; each place stands for those.
            for i in np.flatnonzero(have >= need):
                last = int(place[i])
                out.append((max(int(at[np.searchsorted(at, last, "right") - 1]), last - width + 1), last + 1, t, int(have[i]) / len(tokens)))
        return out

    def own(self, h: np.ndarray, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The matches (first word, end, template, containment) but those that are a rival's: none of the words that tell the template
        from the rival is there, and a match of the rival, with words of its own if it has any, covers half of the span at least."""
        out = []
        by: dict[int, list[tuple[int, int]]] = {}
        for lo, hi, t, _ in spans:
            by.setdefault(t, []).append((lo, hi))

        def before(words: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(np.isin(h, words))])

        def covered(rival: int, words: np.ndarray) -> np.ndarray:
            has, step = before(words), np.zeros(len(h) + 1, np.int64)
            for lo, hi in by.get(rival, ()):
                if not len(words) or has[hi] > has[lo]:
                    step[lo] += 1
                    step[hi] -= 1
            return np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])

        tells = {t: [(before(mine), covered(o, other)) for o, mine, other in self.rivals[t] if o in by] for t in by}
        for lo, hi, t, share in spans:
            if not any(mine[hi] == mine[lo] and 2 * (cover[hi] - cover[lo]) >= hi - lo for mine, cover in tells[t]):
                out.append((lo, hi, t, share))
        return out

    def join(self, h: np.ndarray, block: np.ndarray) -> list[tuple[int, int, float]]:
        """(block, template, containment) for all pairs at or over the threshold. block: that of each word, not falling."""
        if not len(h) or not len(self.prefix):
            return []
        known = np.unique(self.prefix)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        out, seen = [], set()
        for i in hit:
            b = int(block[i])
            for k in range(np.searchsorted(self.prefix, h[i]), np.searchsorted(self.prefix, h[i], "right")):
                t, _ = self.to[k]
                if (b, t) in seen:
                    continue
                seen.add((b, t))
                lo, hi = np.searchsorted(block, b), np.searchsorted(block, b, "right")
                own, tokens, need = h[lo:hi], self.tokens[t], self.need[t]
                if hi - lo < need or len(own := np.unique(own)) < need:  # length
                    continue
                have = np.isin(tokens, own, assume_unique=True)
                if len(tokens) - int(np.argmax(have)) < need:  # positional
                    continue
                if (n := int(have.sum())) >= need:
                    out.append((b, int(t), n / len(tokens)))
        return out


def token_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """In how many texts each template token stands: over all texts; as many rows as templates have tokens."""
    wanted = np.unique(np.concatenate([_hashes(t) for _, t in templates]))

    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                h, at, _ = Texts(part["text"]).words(NON_ALNUM)
                pos = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = np.flatnonzero(wanted[pos] == h)
                text = np.searchsorted(at, hit, "right") - 1
                total += np.bincount(np.unique(text * len(wanted) + pos[hit]) % len(wanted), minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.astype(np.int64)), pa.array(total)], names=["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n")).collect()
    return {r[0] % 2**64: r[1] for r in rows}


def scan(column: pa.Array, templates: Templates, phrases: dict[str, str] = PHRASES) -> dict[str, list]:
    texts = Texts(column)
    h, at, start = texts.words(NON_ALNUM)
    places: list[tuple[int, int, str]] = []
    text_of = np.repeat(np.arange(texts.n), np.diff(at))
    for phrase, label in phrases.items():
        own = _hashes(phrase)
        if len(h) < len(own):
            continue
        same = h[: len(h) - len(own) + 1] == own[0]
        for j in range(1, len(own)):
            same &= h[j : len(h) - len(own) + 1 + j] == own[j]
        for i in np.flatnonzero(same):
            if text_of[i] == text_of[i + len(own) - 1]:
                places.append((int(text_of[i]), int(i - at[text_of[i]]), label))
    breaks = np.flatnonzero(texts.raw == 10)
    # A block's number: the line breaks before it and the texts before it.
    block = np.searchsorted(breaks, start) + text_of
    base: list[list] = [[] for _ in range(texts.n)]
    for t, i, label in places:
        base[t].append((i, label))
    found: list[dict[str, float]] = [{} for _ in range(texts.n)]
    met = templates.join(h, block)
    edge = [np.searchsorted(block, [b for b, _, _ in met], side) for side in ("left", "right")]
    spans = [(int(lo), int(hi), t, share) for lo, hi, (_, t, share) in zip(*edge, met)] + templates.windows(h, at)
    for lo, _, t, share in templates.own(h, spans):
        label, text = templates.labels[t], text_of[lo]
        found[text][label] = max(found[text].get(label, 0.0), share)
    count = np.diff(at)
    return {
        "n_words": count.tolist(),
        "n_base": [len(x) for x in base],
        "first_word": [min(x)[0] if x else None for x in base],
        "last_word": [max(x)[0] if x else None for x in base],
        "base_labels": [",".join(sorted({label for _, label in x})) for x in base],
        "labels": [",".join(sorted({label for _, label in x} | set(f))) for x, f in zip(base, found)],
        "score": [1.0 if x else max(f.values(), default=0.0) for x, f in zip(base, found)],
    }


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = NEAR) -> DataFrame:
    """A row for each document. score: 1 with a base phrase, else the highest containment of a template in a block, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, token_frequencies(docs, templates), threshold))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                out = scan(part["text"], shared.value)
                types = dict.fromkeys(out, pa.int64()) | dict.fromkeys(("base_labels", "labels"), pa.string()) | {"score": pa.float64()}
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(v, types[k]) for k, v in out.items())], names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
