"""Personal data: base patterns against plain regular expressions, Viterbi against all paths, windows against whole lines."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pii
from tessella.llm.arrays import Words, text_buffer

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]).encode())]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return out


pieces = st.sampled_from(["a", "B9", "é", "@", ".", "..", "-", " ", "\n", "+1", "4111 1111 1111 1111", "378282246310005", "1.2.3.4", "256.1.1.1", "007.1.2.3", "x@y.z", "@@", "+49 (30) 123456", "𝄞", "%", "1", "22"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(pieces, max_size=14).map("".join)), max_size=5))
def test_base_spans(texts):
    for t, spans in zip(texts, pii.find(pa.array(texts, pa.string()), pii.default_field()), strict=True):
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == plain(t or "")


def test_viterbi_matches_all_paths():
    f = pii.default_field()
    for words in ([b"call", b"(030)", b"123-4567", b"now"], [b"joe", b"at", b"mail", b"dot", b"com"], [b"x"]):
        e = f.scores(words)
        best = max(itertools.product(range(5), repeat=len(words)), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(f.move[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(f.decode([words])[0]) == best


def test_windows_decode_like_whole_lines():
    f = pii.default_field()
    assert f.settled()
    rng = random.Random(4)
    lines = [ws for ws, _ in pii.labelled_lines(300, 77)]
    texts = ["\n".join(" ".join(rng.choice(lines) + ["plain"] * rng.randrange(9)) for _ in range(20)) for _ in range(20)]
    buf, off = text_buffer(pa.array(texts))
    w = Words(buf, off)
    assert pii.field_spans(w, f) == pii.field_spans(w, f, everything=True)


def test_held_out_accuracy():
    f = pii.default_field()
    test = pii.labelled_lines(400, 99)
    paths = f.decode([[w.encode() for w in ws] for ws, _ in test])
    pairs = [(t, pii.STATES[q]) for (_, ts), p in zip(test, paths, strict=True) for t, q in zip(ts, p, strict=True)]
    hit = sum(t == q != "O" for t, q in pairs)
    assert hit / sum(t != "O" for t, _ in pairs) > 0.9 and hit / sum(q != "O" for _, q in pairs) > 0.9


def test_field_adds_disguised_forms_and_leaves_prose(spark):
    texts = ["Write to joe (at) mail dot com today please", "The cat sat at the door. It was 12 o'clock in 2024.", None, "", "a" * 50_000, "9" * 60_000, "@" * 20_000, "+1 " * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert [(s.kind, texts[0][s.start : s.end], s.base) for s in rows[0]] == [("email", "joe (at) mail dot com", False)]
    assert [rows[i] for i in (1, 2, 3, 4, 5, 6)] == [[]] * 6
    assert pii.find_pii(df.limit(0)).collect() == []


def test_masking(spark):
    df = spark.createDataFrame([(1, "é x@y.org, 1.2.3.4!", 5), (2, None, 6), (None, "plain", 7)], "doc_id long, text string, spans int")
    got = sorted(pii.mask_pii(df).collect(), key=lambda r: r.spans)
    assert [r.text for r in got] == ["é <email>, <ip>!", None, "plain"] and got[0].doc_id == 1


def test_training_improves():
    small = pii.Field.train(pii.labelled_lines(60, 1), epochs=1)
    assert np.isfinite(small.emit).all() and small.move.shape == (5, 5)


#: Lines written by hand, most in forms that `labelled_lines` never makes, with the added spans that a reader would mark.
BY_HAND = [
    ("let us meet at noon dot dot and go", []),
    ("reach me: john dot smith at gmail dot com today", ["john dot smith at gmail dot com"]),
    ("build 10.0.19041.1 is out", []),
    ("ssn 078-05-1120 of him", []),
    ("iban DE89 3704 0044 0532 0130 00 for you", []),
    ("mail john.smith(at)mail.com now", ["john.smith(at)mail.com"]),
    ("call 0171 234 5678 later", ["0171 234 5678"]),
    ("tel 020 7946 0958 please", ["020 7946 0958"]),
    ("Tel: (0221) 4710 815", ["(0221) 4710 815"]),
    ("her address is Mary [at] uni-bonn.de", ["Mary [at] uni-bonn.de"]),
    ("please look at the red dot on it", []),
    ("order 2023-4431 is late", []),
    ("we left at 10:30 on 12/11/2024", []),
    ("room 4111 and floor 12", []),
    ("fax: 555-867-5309.", ["555-867-5309"]),
    ("version 1.2.3 of it", []),
    ("anna_k {at} posteo {dot} de", ["anna_k {at} posteo {dot} de"]),
    ("about 1,250,000 people in 1998 2004 2010", []),
    ("Phone 0228/735566", ["0228/735566"]),
    ("at home at work at sea", []),
    ("5% of 300 at 12.50 each", []),
    ("isbn 978-3-16-148410-0 in print", []),
]


def test_forms_written_by_hand():
    """Recall and precision over whole spans; the README states both."""
    want = {(i, x) for i, (_, xs) in enumerate(BY_HAND) for x in xs}
    found = pii.find(pa.array([t for t, _ in BY_HAND]), pii.default_field())
    got = {(i, BY_HAND[i][0][s["start"] : s["end"]]) for i, spans in enumerate(found) for s in spans if not s["base"]}
    print("recall", len(got & want) / len(want), "precision", len(got & want) / len(got), sorted(got ^ want))
    assert len(got & want) >= 0.7 * len(want) and len(got & want) >= 0.8 * len(got)


#: Lines written after the field was trained for the last time, and not looked at to change it.
HELD_OUT = [
    ("you can reach Peter at peter [at] web [dot] de", ["peter [at] web [dot] de"]),
    ("write jane.doe at example.com soon", ["jane.doe at example.com"]),
    ("ring 1-888-234-5566 before noon", ["1-888-234-5566"]),
    ("my mobile: 0176 4455 6677", ["0176 4455 6677"]),
    ("office (030) 8823410 or mail us", ["(030) 8823410"]),
    ("charged 4242.4242.4242.4242 twice", ["4242.4242.4242.4242"]),
    ("charged 4242.4242.4242.4241 twice", []),
    ("order 8812-3345-9901 has shipped", []),
    ("see you at 18.45 dot org is down", []),
    ("lot 7788-1203 and lot 7788-1204", []),
    ("isbn 3-540-12345-6 second edition", []),
    ("score was 21-19 21-17 at the end", []),
    ("contact lena(at)klinik-mitte.de for it", ["lena(at)klinik-mitte.de"]),
    ("from 1998-2004 he lived at sea", []),
    ("tracking 00340434161094042557 today", []),
    ("fax 555.123.9876 is off", ["555.123.9876"]),
    ("the ratio 3.14159 at 2.71828 again", []),
    ("call 911 or 112", []),
    ("anna dot berg at posteo dot net wrote", ["anna dot berg at posteo dot net"]),
    ("sizes 10 x 20 x 30 at 5.99", []),
    ("phone 0211/9876543, ask for Tom", ["0211/9876543"]),
    ("mac 00:1b:44:11:3a:b7 is known", []),
    ("kim {at} uni {dot} edu", ["kim {at} uni {dot} edu"]),
    ("commit 4f2a9c1 of 2024-05-06 12:30", []),
]


def test_held_out_lines():
    """8 of 11 spans, 10 marked: the README states both."""
    want = {(i, x) for i, (_, xs) in enumerate(HELD_OUT) for x in xs}
    found = pii.find(pa.array([t for t, _ in HELD_OUT]), pii.default_field())
    got = {(i, HELD_OUT[i][0][s["start"] : s["end"]]) for i, spans in enumerate(found) for s in spans if not s["base"]}
    assert len(got & want) >= 0.7 * len(want) and len(got & want) >= 0.75 * len(got)


def test_added_cards_pass_luhn():
    found = pii.find(pa.array(["card 4111.1111.1111.1111", "card 4111.1111.1111.1112", "card 4111 1111 1111 1112"]), pii.default_field())
    assert [[s["kind"] for s in spans] for spans in found] == [["card"], [], []]


def test_margin_costs_no_recall(monkeypatch):
    """The margin saves decoding plain text; a field trained without it finds no more of the held-out words, and must decode all."""
    test = pii.labelled_lines(400, 99)

    def hits(f):
        paths = f.decode([[w.encode() for w in ws] for ws, _ in test])
        return sum(t == pii.STATES[q] != "O" for (_, ts), p in zip(test, paths, strict=True) for t, q in zip(ts, p, strict=True))

    learned = hits(pii.default_field())
    monkeypatch.setattr(pii, "MARGIN", 0.0)
    free = pii.Field.train(pii.labelled_lines())
    assert learned >= hits(free) and not free.settled()


def test_labels_of_plain_words_are_learned():
    """Where labels mark runs of plain words, the field learns that and is not settled, so that whole lines are decoded."""
    f = pii.Field.train([(["the", "name", "is", "hidden", "here"], ["email"] * 5)] * 200, epochs=4)
    assert not f.settled() and (f.decode([[b"some", b"other", b"plain", b"words"]])[0] == 1).all()


def test_long_dense_text_is_linear():
    import time

    text = "1.2.3.4 call 555-123-4567 now " * 8000
    began = time.perf_counter()
    spans = pii.find(pa.array([text]), pii.default_field())[0]
    assert len(spans) == 16_000 and time.perf_counter() - began < 10


def test_added_spans_and_digest_against_plain_code(spark):
    """Spans overlap neither base spans nor each other; the digest columns are what plain Python makes of them."""
    import hashlib

    from tessella.llm import spans as sp

    rng = random.Random(3)
    texts = ["\n".join(" ".join(ws) for ws, _ in pii.labelled_lines(6, rng.randrange(10**6))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).select("doc_id", "spans", *[c.alias(f"d{i}") for i, c in enumerate(sp.digest(sp.F.col("spans"), pii.KINDS))]).collect():
        rank = {k: i for i, k in enumerate(pii.KINDS)}
        assert [(rank[s.kind], s.start) for s in r.spans] == sorted((rank[s.kind], s.start) for s in r.spans)
        added = [s for s in r.spans if not s.base]
        assert not any(a.start < b.end and b.start < a.end for a in added for b in r.spans if a is not b)
        base = [s for s in r.spans if s.base]
        assert [(s.kind, s.start, s.end) for s in base] == plain(texts[r.doc_id] or "")
        join = lambda ss: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in ss)
        assert [r[f"d{i}"] for i in range(4)] == [sum(s.kind == k for s in base) for k in pii.KINDS]
        assert r.d4 == hashlib.sha256(join(base).encode()).hexdigest() and r.d5 == join(r.spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9))))
def test_outside(taken, more):
    from tessella.llm.spans import outside

    taken = [(a, a + n) for a, n in taken]
    more = sorted((a, a + n) for a, n in more)
    kept = list(taken)
    want = []
    for k, (a, b) in enumerate(more):
        if not any(x < b and a < y for x, y in kept):
            kept.append((a, b))
            want.append(k)
    assert outside(taken, more) == want
