"""Line rules: base counts against a plain version, and the verdict on plain and junk documents."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": len(ws) < 50 or 100 * len(hit) > 50 * len(ws)}


def mine(texts):
    out = []
    for _, c, _ in line_rules.judge(pa.array(texts, pa.string())):
        out += [dict(zip(c, (x.item() for x in v), strict=True)) for v in zip(*c.values(), strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t\x0b 𝄞.", max_size=80)), max_size=6))
def test_base_counts(texts):
    for t, got in zip(texts, mine(texts), strict=True):
        want = plain(t)
        assert {k: got[k] for k in want} == want


def test_verdicts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(400)]
    prose = "\n".join(" ".join(rng.choices(words, k=25)).capitalize() + "." for _ in range(8))
    menu = " | ".join(rng.choices(words, k=90))
    noisy = " ".join(w + "###" for w in rng.choices(words, k=90))
    repeated = "\n".join([" ".join(rng.choices(words, k=60)), *["The same line here again."] * 9])
    mixed = prose + "\n" + " | ".join(rng.choices(words, k=8)) + "\nAll rights reserved by us."
    texts = [prose, menu, noisy, mixed, repeated, None, "short"]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = {r.doc_id: r for r in line_rules.line_rules(df).collect()}
    assert [rows[i].kept for i in range(7)] == [True, False, False, True, True, False, False]
    assert rows[3].clean_text == prose and rows[0].clean_text == prose
    assert rows[4].clean_text.count("same line") == 1 and rows[4].lines_failed == 8
    assert line_rules.line_rules(df.limit(0)).collect() == []
