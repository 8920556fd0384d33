"""License scan: base columns against plain code, places against a plain alignment, and texts by another hand."""

import random
import re

import numpy as np
import pyarrow as pa

from tessella.llm import license_scan as ls

SCHEMA = "doc_id long, text string, label string, word long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    ws = WORD.findall((text or "").translate(LOWER))
    spots = sorted((i, label) for p, label in ls.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return len(ws), len(spots), spots[0][0] if spots else None, spots[-1][0] if spots else None, ",".join(sorted({x for _, x in spots}))


def plain_labels(ws, df):
    """Each template at each relative position of its rarest held word, all conditions tried one by one."""
    near = lambda want, at: any(ws[x : x + len(want)] == want for x in range(max(0, at - ls.SLACK), at + ls.SLACK + 1))
    out, best = set(), 0.0
    for label, text, phrases in ls.TEMPLATES:
        t = WORD.findall(text.translate(LOWER))
        anchors = sorted({w for w in t if w in ws}, key=lambda w: (df.get(w, 0), w))[: ls.ANCHORS]
        covers = []
        for f in [i for i, w in enumerate(ws) if anchors and w == anchors[0]]:
            for c in [f - p for p, w in enumerate(t) if w == anchors[0]]:
                if not all(any(near([w], c + p) for p, x in enumerate(t) if x == w) for w in anchors[1:]):
                    continue
                keys = [p.split() for p in phrases]
                if all(near(k, c + next(i for i in range(len(t)) if t[i : i + len(k)] == k)) for k in keys):
                    covers.append(sum(near([w], c + p) for p, w in enumerate(t)) / len(t))
        if covers and max(covers) >= ls.COVER:
            out.add(label)
            best = max(best, max(covers))
    return out, best


def texts(rng):
    filler = ["the", "of", "license", "mit", "Apache", "general", "public", "software", "and", "é", "x", "42", "copy", "terms", "under"]
    out = [None, "", "MIT License", "mit-license, MIT\nlicense", "the Apache licenses", "Apache\x00License"]
    for label, text, _ in ls.TEMPLATES:
        ws = text.split()
        noisy = [w for w in ws if rng.random() > 0.06]
        for k in rng.sample(range(len(noisy)), len(noisy) // 12):
            noisy.insert(k, rng.choice(filler))
        lead = " ".join(rng.choices(filler, k=rng.randrange(30)))
        out += [f"{lead}\n{text}", f"# {lead} {' '.join(noisy)}\n#{lead}", f"{text[: len(text) // 2]} {lead}", f"{lead} {' '.join(reversed(ws))}"]
    return out + [" ".join(rng.choices(filler, k=rng.randrange(60))) for _ in range(60)]


def test_against_plain_code(spark):
    rows = list(enumerate(texts(random.Random(5))))
    rows += [(None, "Released under the MIT License."), (9000, rows[-1][1]), (9000, rows[-1][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = {}
    for r in ls.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = [set(WORD.findall((t or "").translate(LOWER))) for _, t in rows]
    counts = {w: sum(w in d for d in docs) for w in set().union(*docs)}
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        n, n_base, first, last, base = plain_base(t)
        more, best = plain_labels(WORD.findall((t or "").translate(LOWER)), counts)
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base), t
            assert r.labels == ",".join(sorted(more | set(filter(None, base.split(","))))), t
            assert abs(r.score - (best or (0.5 if base else 0.0))) < 1e-12 and 0 <= r.score <= 1


def labels(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r.labels for r in ls.scan_licenses(df).orderBy("doc_id").collect()]


def test_other_hands(spark):
    """Headers as they stand in public projects, wrapped in comments, and texts that speak of licenses without being under one."""
    assert labels(
        spark,
        "/*\n * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n */",
        "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:\n//    * Redistributions of source code must retain the above copyright\n// notice, this list of conditions and the following disclaimer.",
        "-- Permission to use, copy, modify, and distribute this software for any\n-- purpose with or without fee is hereby granted, provided that the above\n-- copyright notice and this permission notice appear in all copies.",
        "Licensed under CC BY-NC 4.0.",
        "Apply for a driving license at the general office; the public may use the software there.",
        "Permission was granted by the editor, free of charge, to print the picture without restriction.",
        "He holds an MIT degree and a fishing license.",
    ) == ["gpl,lgpl", "bsd", "isc", "cc-by-nc", "", "", ""]


def test_edges(spark):
    long = "filler word " * 300_000 + "Released under the MIT License. " * 20_000
    r = ls.scan_licenses(spark.createDataFrame([(1, long, "x", 1)], SCHEMA)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) == (700_000, 20_000, 600_003, 699_998, "mit", 1.0)
    assert ls.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_verified_by_bytes():
    index = ls.Index()
    buf = np.frombuffer("apache mit miz apacha".encode(), np.uint8)
    assert index.numbers(buf, np.array([0, 7, 11, 15]), np.array([6, 10, 14, 21])).tolist() == [index.words.index("apache"), index.words.index("mit"), -1, -1]
    index.hash = np.sort(index.hash.copy())
    index.order = np.roll(index.order, 1)  # hashes that lie: no word is taken for another
    assert (index.numbers(buf, np.array([0]), np.array([6])) == -1).all()
    assert list(ls.scan(pa.array([], pa.string()), index, np.zeros(len(index.words), np.int64))) == []
