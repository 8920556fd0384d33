"""Line-first cleaning: punctuation, navigation and boilerplate rules judge every line, failing lines go, then documents that
lose too much text go.

A line fails if it has words and any of these holds:
- navigation: two or more separators (| or >) that stand alone make up a third of its words, or more;
- punctuation: at least FEW words, and a third of its characters or more are neither letters, digits nor white space
  (characters outside ASCII count as letters), or half its words or more end in two or more symbols;
- boilerplate: it holds a phrase of BOILERPLATE, in either case, and has at most 40 words;
- repetition: it equals an earlier line of the document and has at least FEW words.
A document goes if its failing lines hold more than half of its word characters.

The base counts are exact and do not depend on the line rules.

Nulls and edges: null text counts as empty: no words, so base_failed and not kept; a null id is passed on; rows are judged one by
one, so repeated rows get equal results; very long texts are judged whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, blocks, column, segment_hash, small, strings, take_segments, text_buffer, window_hash

FEW = 4
#: Phrases of notices and navigation; matched in lower case.
BOILERPLATE = (
    b"all rights reserved", b"terms of service", b"terms of use", b"privacy policy", b"cookie policy", b"accept cookies",
    b"subscribe to our newsletter", b"click here to", b"sign up for", b"log in to", b"powered by", b"share this", b"read more",
)
MOST_LOST = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True
_PUNCT = ~_LETTER
_PUNCT[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-split line; a document always has one at least."""
    nl = np.flatnonzero(buf == 10)
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl, "right") - 1])
    start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1)
    end[last] = off[1:]
    return start, np.maximum(end, start), doc


def _repeats(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value within its group: was there an equal one before; is there any other equal one."""
    order = np.lexsort((h, group))
    same = np.zeros(len(h), bool)
    g, v = group[order], h[order]
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    before, any_other = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    any_other[order] = both
    return before, any_other


def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True bytes within each segment."""
    upto = np.concatenate([[0], np.cumsum(mask)])
    return upto[end] - upto[start]


def judge(texts: pa.Array):
    """Yields, per block of documents: first document, dict of per-document arrays, and the kept lines' bytes and offsets."""
    whole, offs = text_buffer(texts)
    for i, j in blocks(offs):
        buf, off = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        w = Words(buf, off)
        docs_of, counts = w.docs(), w.counts
        starts_char = (buf & 0xC0) != 0x80
        chars = _count(starts_char & w.ns, w.start, w.end)
        word_chars = np.bincount(docs_of, chars, n).astype(np.int64)
        symbols = _count(_SYMBOL[buf], off[:-1], off[1:])
        # words in 3-word windows found twice or more
        h = w.hashes()
        win = window_hash(h, 3)
        at = np.arange(len(win))
        at = at[at + 3 <= w.first[1:][docs_of[: len(win)]]]
        _, other = _repeats(docs_of[at], win[at])
        hit = at[other]
        edge = np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + 3, minlength=len(h) + 1)
        repeat_words = np.bincount(docs_of[np.cumsum(edge)[: len(h)] > 0], minlength=n)
        # lines
        ls, le, ld = _lines(buf, off)
        first_word = np.searchsorted(w.start, ls)
        n_line = np.append(first_word[1:], len(w.start)) - first_word
        worded = n_line > 0
        k = np.flatnonzero(worded)
        before, _ = _repeats(ld[k], segment_hash(buf, ls[k], le[k]))
        dup = np.zeros(len(ls), bool)
        dup[k] = before
        dup_lines = np.bincount(ld[dup], minlength=n)
        # rules
        line_of = np.repeat(np.arange(len(ls)), n_line)
        lens = w.end - w.start
        alone = (lens == 1) & np.isin(buf[w.start], list(b"|>"))
        bars = np.bincount(line_of[alone], minlength=len(ls))
        nav = (bars >= 2) & (3 * bars >= n_line)
        tail = np.zeros(len(w.start), bool)
        two = lens > 2
        tail[two] = _PUNCT[buf[w.end[two] - 1]] & _PUNCT[buf[w.end[two] - 2]]
        tails = np.bincount(line_of[tail], minlength=len(ls))
        punct = _count(_PUNCT[buf], ls, le)
        solid = _count(w.ns, ls, le)
        messy = (n_line >= FEW) & ((3 * punct >= solid) | (2 * tails >= n_line))
        plate = np.zeros(len(ls), bool)
        low = _LOWER[buf].tobytes()
        for phrase in BOILERPLATE:
            p = low.find(phrase)
            while p >= 0:
                x = int(np.searchsorted(ls, p, "right")) - 1
                plate[x] |= p + len(phrase) <= le[x] and n_line[x] <= 40
                p = low.find(phrase, p + 1)
        failed = worded & (nav | messy | plate | (dup & (n_line >= FEW)))
        line_chars = np.bincount(line_of, chars, len(ls))
        lost = np.bincount(ld, line_chars * failed, n)
        base_failed = (counts < 50) | (100 * repeat_words > 50 * counts)
        kept = ~base_failed & (lost <= MOST_LOST * word_chars)
        good = ~failed
        data, at = take_segments(buf, ls[good], le[good], ld[good], n, sep=10) if len(buf) else (buf, np.zeros(n + 1, np.int64))
        yield i, {"n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": kept, "lines_failed": np.bincount(ld[failed], minlength=n), "chars_lost": lost.astype(np.int64)}, (data, at)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_failed long, chars_lost long, clean_text string"


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the verdict, what the failing lines held, and the text without them."""

    def run(batches):
        for batch in small(batches):
            for i, c, (data, at) in judge(column(batch, "text")):
                n = len(at) - 1
                yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id").slice(i, n)} | {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in c.items()} | {"clean_text": strings(data, at)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w3 as (select doc_id, i, array_to_string(ws[i:i+2], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
r3 as (select doc_id, i from w3 qualify count(*) over (partition by doc_id, win) > 1),
rw as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r3) group by 1),
s as (select doc_id, string_split(t, chr(10)) as ls from d),
l0 as (select doc_id, unnest(range(1, len(ls) + 1)) as k, unnest(ls) as line from s),
l as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l0),
m as (select *, len(ws) as n, row_number() over (partition by doc_id, line order by k) > 1 and len(ws) > 0 as dup,
  coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as chars, coalesce(list_sum(list_transform(ws, lambda w: strlen(w))), 0) as solid,
  len(list_filter(ws, lambda w: w in ('|', '>'))) as bars, length(regexp_replace(line, '[A-Za-z0-9\x09-\x0D\x20]|[^\x00-\x7F]', '', 'g')) as punct,
  len(list_filter(ws, lambda w: strlen(w) > 2 and regexp_matches(w, '[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{2}$'))) as tails,
  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from l),
f as (select *, n > 0 and ((bars >= 2 and 3 * bars >= n) or (n >= 4 and (3 * punct >= solid or 2 * tails >= n)) or (n <= 40 and (PHRASES)) or (dup and n >= 4)) as failed from m),
g as (select doc_id, sum(dup::int)::bigint as n_dup_lines, sum(failed::int)::bigint as lines_failed, sum(case when failed then chars else 0 end)::bigint as chars_lost, sum(chars)::bigint as word_chars from f group by 1),
b as (select d.doc_id, len(ws)::bigint as n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, n_dup_lines, coalesce(rw.n, 0)::bigint as n_repeat_words, lines_failed, chars_lost
  from d join g using (doc_id) left join rw using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and chars_lost <= 0.5 * word_chars as kept, lines_failed, chars_lost from v
""".replace("PHRASES", " or ".join(f"contains(low, '{p.decode()}')" for p in BOILERPLATE))
