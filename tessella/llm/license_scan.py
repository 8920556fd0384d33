"""License scan by a positional rare-token index.

Templates are texts of public licenses and their usual notices, each with key phrases that a file must hold. The index lists for every licence
word its templates and positions there. Document frequencies of the licence words are counted over all documents, so a word's IDF is
the corpus's. A template is looked at only where the file holds the highest-IDF word of its key phrases (a file without that word cannot
have the phrase). Of the template's words that the file holds the ANCHORS of highest IDF are looked up: every occurrence of the first, at
every posting, gives a relative position (word in the file less word in the template), and stays if the other anchors stand within SLACK
words of where that puts them. Then all key phrases must stand there, within SLACK words, and COVER of the template's words.

score: the share of a template's words at the best verified place; if there is none, 0.5 where a base phrase stands, else 0.

Nulls and edges: null text counts as empty: no words, no places, score 0; a null id is passed on; rows are judged one by one, so repeated
rows get equal results; very long texts are read whole, and the places of a phrase are handled together however many they are; ties of IDF
go by position in the list of templates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, column, runs, segment_hash, small, take_segments, text_buffer
from .simhash import _LOWER

ANCHORS, SLACK, COVER = 3, 4, 0.75
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# fixed values: the contract's phrases and labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# fixed values: label, text of a public license or of a notice of it, key phrases
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "with or without modification", "provided that the following conditions are met"),
    ),
    ("bsd", "licensed under the BSD License", ("under the bsd license",)),
    ("bsd", "licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    ("bsd", "licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license as published by the free software foundation", "redistribute it and or modify it"),
    ),
    ("gpl", "licensed under the GNU General Public License", ("gnu general public license",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("mit", "Released under the MIT License", ("under the mit license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("without any express or implied warranty", "in no event will the authors be held liable")),
)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Index:
    """Vocabulary of the templates and base phrases, and the templates as word numbers with the places of their key phrases."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [words_of(t) for _, t, _ in templates]
        self.words = sorted({w for t in texts for w in t} | {w for p, _ in base for w in words_of(p)})
        number = {w: i for i, w in enumerate(self.words)}
        self.base = [(np.array([number[w] for w in words_of(p)]), label) for p, label in base]
        self.templates = []
        for (label, _, phrases), t in zip(templates, texts, strict=True):
            keys = [words_of(p) for p in phrases]
            at = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for k in keys]
            self.templates.append((label, np.array([number[w] for w in t]), [(a, np.array([number[w] for w in k])) for a, k in zip(at, keys, strict=True)]))
        raw = [w.encode() for w in self.words]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.end = np.cumsum([len(w) for w in raw])
        self.start = self.end - np.array([len(w) for w in raw])
        h = segment_hash(self.data, self.start, self.end)
        self.order = np.argsort(h)
        self.hash = h[self.order]

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 of any other; found by hash and verified by bytes."""
        out = np.full(len(start), -1, np.int64)
        if not len(start):
            return out
        h = segment_hash(buf, start, end)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == h)
        mine = self.order[at[hit]]
        hit, mine = (x[(end - start)[hit] == (self.end - self.start)[mine]] for x in (hit, mine))
        n = len(hit)
        a, off = take_segments(buf, start[hit], end[hit], np.arange(n), n)
        b, _ = take_segments(self.data, self.start[mine], self.end[mine], np.arange(n), n)
        wrong = np.searchsorted(off, np.flatnonzero(a != b), "right") - 1
        right = np.ones(n, bool)
        right[wrong] = False
        out[hit[right]] = mine[right]
        return out


def _numbered(texts: pa.Array, index: Index):
    """(first document, vocabulary numbers of all words, first word of each document) of each block of texts."""
    buf, off = text_buffer(texts)
    for i, j in blocks(off):
        b, o = _LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end = runs(_IN_WORD[b], o)
        yield i, index.numbers(b, start, end), np.searchsorted(start, o)


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand consecutively."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def _near(spots: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Whether one of the sorted spots is within SLACK of each wanted place."""
    return np.searchsorted(spots, want + SLACK, "right") > np.searchsorted(spots, want - SLACK, "left")


def aligned(ids: np.ndarray, template: np.ndarray, keys: list, rarity: np.ndarray) -> tuple[int, float] | None:
    """(first word, share of the template) of the best verified place of a template, None without one. rarity: less is rarer."""
    held = np.unique(template[np.isin(template, ids)])
    anchors = held[np.lexsort((held, rarity[held]))][:ANCHORS]
    if not len(anchors):
        return None
    spots = {w: np.flatnonzero(ids == w) for w in held.tolist()}
    c = np.unique((spots[int(anchors[0])][:, None] - np.flatnonzero(template == anchors[0])[None]).ravel())
    for w in anchors[1:].tolist():  # the postings of the other anchors, at the same relative position
        c = c[np.logical_or.reduce([_near(spots[w], c + p) for p in np.flatnonzero(template == w)])]
    for at, phrase in keys:
        c = c[_near(places(ids, phrase), c + at)]
    if not len(c):
        return None
    there = np.zeros(len(c), np.int64)
    for p, w in enumerate(template.tolist()):
        if w in spots:
            there += _near(spots[w], c + p)
    best = int(np.argmax(there))
    cover = float(there[best] / len(template))
    return (max(0, int(c[best])), cover) if cover >= COVER else None


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """Documents that hold each word of the vocabulary, over all documents: a number a word comes to the driver."""
    n = len(index.words)

    def count(batches):
        df = np.zeros(n, np.int64)
        for batch in small(batches):
            for _, ids, first in _numbered(column(batch, "text"), index):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[ids >= 0]
                df += np.bincount(np.unique(doc * n + ids[ids >= 0]) % n, minlength=n)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(n), pa.int32()), "docs": pa.array(df)})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    out = np.zeros(n, np.int64)
    for r in counted.collect():
        out[r["word"]] = r["docs"]
    return out


def scan(texts: pa.Array, index: Index, df: np.ndarray):
    """Yields of each block of texts the columns of `scan_licenses` but the id."""
    # of each template: the rarest word of its key phrases, without which there is no such phrase
    needs = [min((int(df[w]), int(w)) for _, phrase in keys for w in phrase)[1] for _, _, keys in index.templates]
    starter = np.unique([*needs, *[int(min(p, key=lambda w: (df[w], w))) for p, _ in index.base]])
    for i, ids, first in _numbered(texts, index):
        n = len(first) - 1
        out: dict[str, list] = {"n_words": np.diff(first).tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "matches": [[] for _ in range(n)]}
        for d in np.unique(np.searchsorted(first, np.flatnonzero(np.isin(ids, starter)), "right") - 1).tolist():
            mine = ids[first[d] : first[d + 1]]
            spots = [(places(mine, p), label) for p, label in index.base]
            every = np.concatenate([s for s, _ in spots])
            base = sorted({label for s, label in spots if len(s)})
            here = set(np.unique(mine).tolist())
            found = []
            for (label, template, keys), need in zip(index.templates, needs, strict=True):
                if need in here and (hit := aligned(mine, template, keys, df)):
                    found.append({"label": label, "word": hit[0], "cover": hit[1]})
            out["n_base"][d] = len(every)
            if len(every):
                out["first_word"][d], out["last_word"][d] = int(every.min()), int(every.max())
            out["base_labels"][d], out["labels"][d] = ",".join(base), ",".join(sorted({*base, *[m["label"] for m in found]}))
            out["score"][d] = max([m["cover"] for m in found], default=0.5 if base else 0.0)
            out["matches"][d] = found
        yield i, out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, word, cover of each verified template)."""
    index = Index()
    df = document_frequencies(docs, index, text_col)
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long,cover:double>>"
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("cover", pa.float64())]))}

    def run(batches):
        for batch in small(batches):
            for i, out in scan(column(batch, "text"), index, df):
                yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id").slice(i, len(out["score"]))} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {schema}")
