"""Conversation repair against a search over all edits, with conversations cut into many chunks, and edges."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessella.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, pos long, audit string"


def damage(rows, damaged):
    out = []
    for c, t, role, text in rows:
        kind = 9 if not damaged else zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        key = (t is not None, t or 0, role, hashlib.sha256(text.encode()).digest())
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, key, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, damaged=True):
    """Dijkstra over (row, grammar state) by (cost, audit); every edit is tried."""
    given = damage(rows, damaged)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in given if r[0] == conv), key=lambda r: r[0])
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        into = {"": "u", "s": "u", "u": "a", "a": "u"}
        heap, done, best = [(0, "", 0, "", ())], set(), None
        while heap:
            cost, audit, i, state, said = heapq.heappop(heap)
            if i == len(mine) and state in ("", "a"):
                best = (cost, audit, "\n".join(said))
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            name = {"u": "user", "a": "assistant"}[into[state]]
            heapq.heappush(heap, (cost + 3, audit + "I", i, into[state], (*said, f"{name}:")))
            if i < len(mine):
                _, _, role, text = mine[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
                if faults[i] in ("", "truncated"):
                    more = 3 * (faults[i] == "truncated")
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, into[state], (*said, f"{name}:{text}")))
                    first = role[:1]
                    if first == into[state] or (first == "s" and state == ""):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, first, (*said, f"{role}:{text}")))
        out[conv] = (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def mine(spark, rows, damaged=True):
    return {r[0]: tuple(r[1:]) for r in cr.report(table(spark, rows), damaged).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made(rng, n, conv):
    texts = [None, "", " \t", "Yes.", "no", "Why? ", "Well!\n", "a. b", "é!", "..", "long " * 40 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "sage", "", "Ünder"]
    return [(conv, rng.choice([None, 0, 1, 2, 3, 4, 7, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 12])
def test_against_search(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for c in range(60) for r in made(rng, rng.randrange(1, 12), c)] + made(rng, 90, None) + made(rng, 40, -5)
    rows += [(100, 1, "user", "Same.")] * 7 + [(101, None, "user", None)] * 3  # equal rows
    for damaged in (True, False):
        assert mine(spark, rows, damaged) == brute(rows, damaged)


def test_long_conversation(spark, monkeypatch):
    """One conversation holds nearly all rows; its segments lie in many chunks and ranges."""
    monkeypatch.setattr(cr, "CHUNK_BITS", 5)
    monkeypatch.setattr(cr, "RANGE_ROWS", 200)
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice([f"Text {t}.", f"cut {t}", "Again.", ""])) for t in range(3000) if t % 17] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    assert mine(spark, rows) == brute(rows)


def test_repaired_rows_and_edges(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hello."), (1, 2, "user", " "), (2, 0, "user", "Yes."), (2, 2, "assistant", "cut off"), (3, 0, "user", " ")]
    got = cr.repair(table(spark, rows)).orderBy("conv_id", "place").collect()
    # conversation 1: the assistant's row may get a user before it, or become one with an answer: I is least
    assert [tuple(r) for r in got] == [(1, 0, "system", "Be good."), (1, 1, "user", ""), (1, 2, "assistant", "Hello."), (2, 0, "user", "Yes."), (2, 1, "assistant", "cut off")]
    assert mine(spark, []) == {}
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert mine(spark, [(*dropped, "user", "Gone.")]) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    huge = [(5, 0, "user", "word " * 400_000 + "end."), (5, 1, "assistant", "x" * 2_000_000)]
    assert mine(spark, huge, False) == brute(huge, False)
