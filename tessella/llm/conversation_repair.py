"""Conversation structure repair by weighted finite-state composition.

A conversation's rows are an input acceptor, the edits (Keep, Rerole, Delete, Insert) a transducer, and the role grammar (s?(ua)+)? an
acceptor of four states (nothing yet, after s, after u, after a). They are composed lazily: a composed state is a row and a grammar state.
Weights are (cost, audit) in lexicographic order. Costs to go are found backwards in topological order; inserts, which take no row,
are relaxed between rows. Walking forwards, the least letter among the arcs of least cost is taken: from a composed state each letter leads
to one state, and audits of equal cost never are one another's beginnings (each letter but I takes a row, and I costs), so this is
the least audit.

A conversation may hold any share of all rows, so none is gathered: rows without their texts are put into one global order by range,
cut into chunks, and a chunk's segment of a conversation becomes a 4 x 4 matrix of costs over (min, +). Matrices of a conversation are
multiplied (a matrix for some CHUNK rows), which gives each segment the costs to go behind it; each segment then walks from all four states at
once, and the exits are chained. Texts move once, dealt by conversation and sorted, and stream past the audit. The digest of a conversation is
one SHA-256, which takes bytes in order: that stream alone runs in one task a conversation, a batch in memory.

Order: by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text (before damage); equal rows follow each other.

Nulls and edges: a null role or text, and a null conv_id or turn within the damage's key, is one space; a null conv_id is a conversation of
its own; null turns come first and count for no gap; a role counts by its first character; rows that are equal in all columns are one row with a
count until texts stream; very long texts are read whole, and never sorted by; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .arrays import column, small

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: log2 of the distinct rows of a chunk; rows of a range.
CHUNK_BITS, RANGE_ROWS = 12, 2_000_000
#: Segments of conversations whose matrices are multiplied in one group, on average.
UNIT_SEGMENTS = 200_000

#: Grammar states: nothing yet, after s, after u, after a; 4 stands for none.
_INTO = np.array([2, 2, 3, 2])  # where the next user or assistant leads, be it inserted or a row given that role
_KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])  # by class of the row: s, u, a, other
_NEVER = np.int64(1 << 50)
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # costs to go behind the last row
_ROLES = ("user", "user", "assistant", "user")
_CLASS = {"s": 0, "u": 1, "a": 2}
LEGAL = ("su", "ua", "au")
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"


# ---- the composed machine; all in numpy over many segments side by side ----


def _options(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (n, 4) of Delete, Keep and Rerole of each row in each state; code: fault + 4 * class; after: costs to go behind the row."""
    fault = code & 3
    more = np.where(fault == _TRUNCATED, TRUNCATED, 0)[:, None]
    must = ((fault == _BLANK) | (fault == _DUPLICATE))[:, None]
    wide = np.concatenate([after, np.full((len(code), 1), _NEVER)], 1)
    keep = np.where(must, _NEVER, more + np.take_along_axis(wide, _KEEP[code >> 2], 1))
    rerole = np.where(must, _NEVER, more + REROLE + after[:, _INTO])
    return DELETE + after, keep, rerole


def _relaxed(b: np.ndarray) -> np.ndarray:
    """b with inserts allowed before what it costs."""
    w = b.copy()
    w[:, 2] = np.minimum(b[:, 2], INSERT + b[:, 3])
    w[:, 3] = np.minimum(b[:, 3], INSERT + b[:, 2])
    w[:, 0] = np.minimum(b[:, 0], INSERT + w[:, 2])
    w[:, 1] = np.minimum(b[:, 1], INSERT + w[:, 2])
    return w


def _longest_first(length: np.ndarray):
    """Order of segments by falling length, and for each step how many are that long."""
    order = np.argsort(-length, kind="stable")
    return order, [int(np.searchsorted(-length[order], -s, "left")) for s in range(int(length.max()) if len(length) else 0)]


def costs(code: np.ndarray, copies: np.ndarray, first: np.ndarray, length: np.ndarray, end: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Costs to go (segments, 4) before each segment (rows first ... first + length - 1), given those behind it; after: gets those behind each row."""
    order, active = _longest_first(length)
    w = end[order].astype(np.int64)
    for s, n in enumerate(active):
        rows = first[order[:n]] + length[order[:n]] - 1 - s
        behind = w[:n] + DELETE * (copies[rows] - 1)[:, None]  # all copies but the first are deleted
        if after is not None:
            after[rows] = behind
        w[:n] = np.minimum(_relaxed(np.minimum.reduce(_options(code[rows], behind))), _NEVER)
    out = np.empty_like(w)
    out[order] = w
    return out


def matrices(code: np.ndarray, copies: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(segments, 4, 4): least cost from a state before the segment to one behind its last row."""
    unit = np.where(np.eye(4, dtype=bool), np.int64(0), _NEVER)
    w = costs(code, copies, np.repeat(first, 4), np.repeat(length, 4), np.tile(unit, (len(first), 1)))
    return w.reshape(-1, 4, 4).transpose(0, 2, 1)


def walks(code: np.ndarray, copies: np.ndarray, first: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """The state (segments, 4) in which each segment is left by the entered state, and the least audits of the four."""
    after = np.zeros((len(code), 4), np.int64)
    costs(code, copies, first, length, end, after)
    delete, keep, rerole = _options(code, after)
    w = _relaxed(np.minimum.reduce([delete, keep, rerole]))
    insert = INSERT + w[:, _INTO]
    # ASCII order: D, I, K, R
    letter = np.select([delete == w, insert == w, keep == w], [ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
    at = np.tile(np.arange(4), (len(code), 1))
    inserted = np.zeros((len(code), 4), np.int64)
    for _ in range(2):  # s, then user, then assistant: more never pay
        also = np.take_along_axis(letter, at, 1) == ord("I")
        at, inserted = np.where(also, _INTO[at], at), inserted + also
    taken = np.take_along_axis(letter, at, 1)
    following = np.where(taken == ord("D"), at, np.where(taken == ord("K"), np.take_along_axis(_KEEP[code >> 2], np.minimum(at, 3), 1), _INTO[at]))
    order, active = _longest_first(length)
    state = np.tile(np.arange(4), (len(first), 1))
    path = np.zeros((len(code), 4), np.int64)
    for s, n in enumerate(active):
        rows = first[order[:n]] + s
        path[rows] = state[:n]
        state[:n] = np.take_along_axis(following[rows], state[:n], 1)
    exits = np.empty_like(state)
    exits[order] = state
    n_in, action = np.take_along_axis(inserted, path, 1), np.take_along_axis(taken, path, 1)
    pieces = np.zeros((len(code), 4, 4), np.uint8)  # row, entered state, letters: two inserts, the action, what stands for the copies
    pieces[:, :, 0], pieces[:, :, 1], pieces[:, :, 2] = np.where(n_in > 1, ord("I"), 0), np.where(n_in > 0, ord("I"), 0), action
    pieces[:, :, 3] = np.where(copies > 1, ord("D"), 0)[:, None]
    audits = []
    for a, n in zip(first.tolist(), length.tolist(), strict=True):
        mine = []
        for e in range(4):
            flat = pieces[a : a + n, e].ravel()
            if (copies[a : a + n] > 1).any():
                flat = np.repeat(flat, np.stack([np.ones(n, int)] * 3 + [np.maximum(copies[a : a + n] - 1, 1)], 1).ravel())
            mine.append(flat[flat > 0].tobytes().decode("ascii"))
        audits.append(mine)
    return exits, audits


# ---- rows ----


def ordered_keys(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies, and by_role, by_text, which order the rows of a turn."""
    out = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    return out.withColumns({"copies": F.lit(1).cast("long"), "by_role": F.col("role"), "by_text": F.unhex(F.sha2("text", 256))})


def damaged(rows: DataFrame) -> DataFrame:
    """rows (ordered_keys) with one in twenty each dropped, emptied, without [.!?], repeated, and given the role user, by a CRC of conv_id:turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(F.col("copies")).cast("long").alias("copies"), "by_role", "by_text")


_ORDER = ("conv_id", "turn", "by_role", "by_text")


def _placed(rows: DataFrame, scratch: cluster.Scratch) -> DataFrame:
    """Distinct rows without their texts, in one order over all conversations: pos."""
    words = F.rtrim(F.col("text"), F.lit(_SPACE))
    light = rows.select(*_ORDER, "copies", "role", F.when(F.col("text") == "", F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.unhex(F.sha2("text", 256))).alias("said"), (words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    one = light.groupBy(*_ORDER).agg(F.sum("copies").alias("copies"), *[F.min(c).alias(c) for c in ("role", "said", "blank", "cut")])
    one = scratch.table(one)
    n = cluster.tasks(rows.sparkSession, cluster.units(rows.sparkSession, one.count(), RANGE_ROWS))
    return scratch.table(one.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("pos", F.monotonically_increasing_id()))


def _segments(placed: DataFrame) -> DataFrame:
    """A row for each run of a conversation's rows in a chunk: its codes, counts, borders and matrix."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    firsts = placed.groupBy("conv_id", "role", "said").agg(F.min("pos").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "least")
    # a hot text is split by adaptive execution
    again = placed.join(firsts.hint("merge"), placed["conv_id"].eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))).filter("pos > least").select("pos")
    light = placed.select("pos", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "cut", "copies", F.lit(False).alias("again"))
    every = light.unionByName(again.withColumn("again", F.lit(True)), allowMissingColumns=True).withColumn("chunk", F.shiftright("pos", CHUNK_BITS))

    def cut(table: pa.Table) -> pa.Table:
        pos, flag = column(table, "pos").to_numpy(), column(table, "again").to_numpy(zero_copy_only=False)
        seen = pos[flag]
        t = table.filter(pa.array(~flag)).sort_by("pos")
        pos = column(t, "pos").to_numpy()
        blank, cut, copies = (column(t, c).to_numpy(zero_copy_only=False) for c in ("blank", "cut", "copies"))
        fault = np.where(blank, _BLANK, np.where(np.isin(pos, seen), _DUPLICATE, np.where(cut, _TRUNCATED, 0)))
        initial = column(t, "initial").to_pylist()
        code = fault + 4 * np.array([_CLASS.get(x, 3) for x in initial], np.int64)
        conv = column(t, "conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.diff(conv, prepend=-1) != 0
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(conv)))
        turn = column(t, "turn")
        has = turn.is_valid().to_numpy(zero_copy_only=False)
        value = turn.fill_null(0).to_numpy()
        fresh = has & (new | ~np.append(False, has[:-1]) | (value != np.append(0, value[:-1])))
        wrong = np.array([False] + [a + b not in LEGAL for a, b in zip(initial, initial[1:], strict=False)]) & ~new
        last = first + length - 1
        some = np.add.reduceat(has, first) > 0
        low = np.minimum.reduceat(np.where(has, value, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(has, value, np.iinfo(np.int64).min), first)
        total = lambda x: pa.array(np.add.reduceat(np.asarray(x, np.int64), first))
        m = matrices(code, copies, first, length).reshape(-1, 16)
        return pa.table(
            {
                "conv_id": column(t, "conv_id").take(pa.array(first)), "start": pa.array(pos[first]),
                "code": pa.array([code[a : a + n].astype(np.uint8).tobytes() for a, n in zip(first, length, strict=True)], pa.binary()),
                "copies": pa.array([copies[a : a + n].tobytes() if (copies[a : a + n] > 1).any() else None for a, n in zip(first, length, strict=True)], pa.binary()),
                "matrix": pa.array([x.tobytes() for x in m], pa.binary()),
                "blank": total(np.where(fault == _BLANK, copies, 0)), "duplicate": total(np.where(fault == _BLANK, 0, copies - (fault != _DUPLICATE))), "truncated": total(fault == _TRUNCATED),
                "illegal": total(wrong + copies - 1), "turns": total(fresh), "low": pa.array(low, mask=~some), "high": pa.array(high, mask=~some),
                "opens": pa.array([initial[a] for a in first], pa.string()), "closes": pa.array([initial[a] for a in last], pa.string()),
            }
        )

    made = f"conv_id {kind}, start long, code binary, copies binary, matrix binary, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, opens string, closes string"
    return every.groupBy("chunk").applyInArrow(cut, made)


def _by_conversation(df: DataFrame, n_units: int):
    """Small rows of segments, dealt in units of conversations."""
    spark = df.sparkSession
    return df.withColumn("unit", F.pmod(F.xxhash64("conv_id"), F.lit(n_units))).repartition(cluster.tasks(spark, n_units), "unit").groupBy("unit")


def _runs(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """t in order of start, and the first row and the length of each conversation in it."""
    t = t.sort_by("start")
    conv = column(t, "conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(conv, prepend=-1))
    return t, first, np.diff(np.append(first, len(conv)))


def _composed(t: pa.Table) -> pa.Table:
    """Costs to go behind each segment; a conversation's first segment has its figures."""
    t, first, length = _runs(t)
    m = np.frombuffer(b"".join(column(t, "matrix").to_pylist()), np.int64).reshape(-1, 4, 4)
    behind = np.zeros((len(m), 4), np.int64)
    order, active = _longest_first(length)
    w = np.tile(_END, (len(first), 1))
    for s, n in enumerate(active):
        rows = first[order[:n]] + length[order[:n]] - 1 - s
        behind[rows] = w[:n]
        w[:n] = (m[rows] + w[:n, None, :]).min(2)
    cost = np.empty(len(first), np.int64)
    cost[order] = w[:, 0]
    total = lambda c: np.add.reduceat(column(t, c).to_numpy(), first)
    inner = np.ones(len(m), bool)
    inner[first] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    which = np.repeat(np.arange(len(first)), length)[after]
    opens, closes, low, high = (column(t, c).to_pylist() for c in ("opens", "closes", "low", "high"))
    wrong = np.bincount(which, [closes[a] + opens[b] not in LEGAL for a, b in zip(before, after, strict=True)], len(first)).astype(np.int64)
    met = np.bincount(which, [high[a] is not None and high[a] == low[b] for a, b in zip(before, after, strict=True)], len(first)).astype(np.int64)  # a turn on both sides of a border
    gaps = []
    for a, n, d in zip(first.tolist(), length.tolist(), (total("turns") - met).tolist(), strict=True):
        lows, highs = [x for x in low[a : a + n] if x is not None], [x for x in high[a : a + n] if x is not None]
        gaps.append(max(highs) - min(lows) + 1 - d if lows else 0)
    alone = lambda x: pa.array(np.asarray(x, np.int64)).take(pa.array(np.repeat(np.arange(len(first)), length), mask=inner))
    figures = {"gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": total("illegal") + wrong, "cost": cost}
    return pa.table({"conv_id": column(t, "conv_id"), "start": column(t, "start"), "behind": pa.array([x.tobytes() for x in behind], pa.binary())} | {k: alone(v) for k, v in figures.items()})


def _walked(batches):
    for batch in small(batches):
        codes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in column(batch, "code").to_pylist()]
        length = np.array([len(x) for x in codes], np.int64)
        copies = [np.ones(n, np.int64) if x is None else np.frombuffer(x, np.int64) for x, n in zip(column(batch, "copies").to_pylist(), length, strict=True)]
        if not len(codes):
            continue
        end = np.frombuffer(b"".join(column(batch, "behind").to_pylist()), np.int64).reshape(-1, 4)
        exits, audits = walks(np.concatenate(codes), np.concatenate(copies), np.cumsum(length) - length, length, end)
        yield pa.RecordBatch.from_pydict({"conv_id": column(batch, "conv_id"), "start": column(batch, "start"), "exits": pa.array([x.astype(np.uint8).tobytes() for x in exits], pa.binary()), "audits": pa.array(audits, pa.list_(pa.string()))})


def _chained(t: pa.Table) -> pa.Table:
    """The state in which each segment is entered, and the inserts behind a conversation's last."""
    t, first, length = _runs(t)
    exits = np.frombuffer(b"".join(column(t, "exits").to_pylist()), np.uint8).reshape(-1, 4)
    entered, state = np.zeros(len(exits), np.int32), np.zeros(len(first), np.int64)
    order, active = _longest_first(length)
    for s, n in enumerate(active):
        rows = first[order[:n]] + s
        entered[rows] = state[:n]
        state[:n] = exits[rows, state[:n]]
    left = np.empty_like(state)
    left[order] = state
    tail = np.full(len(exits), "", object)
    tail[first + length - 1] = np.array(["", "II", "I", ""], object)[left]
    return pa.table({"start": column(t, "start"), "entered": pa.array(entered), "tail": pa.array(tail, pa.string())})


def plan(rows: DataFrame, scratch: cluster.Scratch) -> tuple[DataFrame, DataFrame]:
    """rows: as ordered_keys gives them. Returns figures (conv_id, gaps, blank, duplicate, truncated, illegal, cost) and audits of segments
    (the order columns of their first row, start, audit), tables of scratch."""
    placed = _placed(rows, scratch)
    kind = placed.schema["conv_id"].dataType.simpleString()
    segments = scratch.table(_segments(placed))
    n_units = cluster.units(rows.sparkSession, segments.count(), UNIT_SEGMENTS)
    figures = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    composed = scratch.table(_by_conversation(segments.drop("code", "copies"), n_units).applyInArrow(_composed, f"conv_id {kind}, start long, behind binary, {figures}"))
    walked = scratch.table(segments.select("start", "conv_id", "code", "copies").join(composed.select("start", "behind"), "start").mapInArrow(_walked, f"conv_id {kind}, start long, exits binary, audits array<string>"))
    chained = _by_conversation(walked.select("conv_id", "start", "exits"), n_units).applyInArrow(_chained, "start long, entered int, tail string")
    audits = walked.join(chained, "start").select("start", F.concat(F.element_at("audits", F.col("entered") + 1), "tail").alias("audit"))
    audits = audits.join(placed.select(*_ORDER, F.col("pos").alias("start")), "start")
    return composed.filter("cost is not null").drop("start", "behind"), scratch.table(audits)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations: texts and audits by conversation, sorted, as a stream."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    both = audits.select(*_ORDER, F.lit(0).alias("is_row"), "audit").unionByName(rows.select(*_ORDER, F.lit(1).alias("is_row"), "role", "text", "copies"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(*_ORDER, "is_row")

    def apply(batches):
        conv, state, place, letters = object(), 0, 0, iter("")
        out: dict[str, list] = {"conv_id": [], "place": [], "role": [], "text": []}
        at = None

        def put(role, text):
            nonlocal place
            for k, v in zip(out, (conv, place, role, text), strict=True):
                out[k].append(v)
            place += 1

        def batch_of():
            b = pa.RecordBatch.from_arrays([pa.array(out["conv_id"], at), pa.array(out["place"], pa.int64()), pa.array(out["role"], pa.string()), pa.array(out["text"], pa.string())], names=list(out))
            for v in out.values():
                v.clear()
            return b

        def inserts():
            """Inserts up to the next letter that takes a row, and that letter."""
            nonlocal state
            for x in letters:
                if x != "I":
                    return x
                put(_ROLES[state], "")
                state = int(_INTO[state])
            return None

        for batch in small(batches):
            at = batch.schema.field("conv_id").type
            for c, is_row, audit, role, text, copies in zip(*[column(batch, n).to_pylist() for n in ("conv_id", "is_row", "audit", "role", "text", "copies")], strict=True):
                if not is_row:
                    inserts()  # those behind a conversation's last row
                    if c != conv:
                        conv, state, place = c, 0, 0
                    letters = iter(audit)
                    continue
                for _ in range(copies):
                    action = inserts()
                    if action == "K":
                        put(role, text)
                        state = int(_KEEP[_CLASS[role[0]], state])
                    elif action == "R":
                        put(_ROLES[state], text)
                        state = int(_INTO[state])
            yield batch_of()
        inserts()
        if at is not None:
            yield batch_of()

    return both.mapInArrow(apply, f"conv_id {kind}, place long, role string, text string")


def _hashed(repaired: DataFrame) -> DataFrame:
    """conv_id, sha of role:text, newline-joined; repaired: as `repaired` gives it, in its order."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        conv, h, at = None, None, None
        for batch in batches:
            at = batch.schema.field("conv_id").type
            done: list[tuple] = []
            for c, place, role, text in zip(*[column(batch, n).to_pylist() for n in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    done += [] if h is None else [(conv, h.hexdigest())]
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], at), pa.array([d for _, d in done], pa.string())], names=["conv_id", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], at), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "sha"])

    return repaired.mapInArrow(stream, f"conv_id {kind}, sha string")


def repair(conversations: DataFrame, damage: bool = False, **columns: str) -> DataFrame:
    """conv_id, place, role, text of all conversations after the cheapest repair (those that end up empty have no rows)."""
    with cluster.Scratch(conversations.sparkSession) as scratch:
        rows = ordered_keys(conversations, **columns)
        rows = damaged(rows) if damage else rows
        return cluster.materialize(repaired(rows, plan(rows, scratch)[1]))


def report(conversations: DataFrame, damage: bool = False, **columns: str) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    with cluster.Scratch(conversations.sparkSession) as scratch:
        original = ordered_keys(conversations, **columns)
        rows = damaged(original) if damage else original
        figures, audits = plan(rows, scratch)
        whole = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        every = original.select("conv_id").distinct()
        for part in (figures, whole, _hashed(repaired(rows, audits))):
            every = every.unionByName(part, allowMissingColumns=True)
        counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        out = every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return cluster.materialize(out)


def _sql() -> str:
    """The same composition as a fold over each conversation's rows: of every grammar state the least (cost, audit) so far, with its text."""
    said = lambda z, role: f"x.{z}.o || case when x.{z}.o = '' then '' else chr(10) end || {role} || ':'"
    arc = lambda z, cost, letter, o: f"{{'c': x.{z}.c + {cost}, 'a': x.{z}.a || '{letter}', 'o': {o}}}"
    ins = lambda z, role: arc(z, 3, "I", said(z, f"'{role}'"))
    more = "case y.f when 3 then 3 when 0 then 0 else 1000000 end"  # a million: no such arc
    keep = lambda z, c: arc(z, f"{more} + case when left(y.r, 1) = '{c}' then 0 else 1000000 end", "K", said(z, "y.r") + " || y.t")
    rerole = lambda z, role: arc(z, f"{more} + 3", "R", said(z, f"'{role}'") + " || y.t")
    delete = lambda z: arc(z, 4, "D", f"x.{z}.o")
    into_u = lambda f: ", ".join(f(z) for z in "psq")
    none = "{'c': 1000000::bigint, 'a': '', 'o': ''}"
    step = f"""{{'k': y.k, 'f': y.f, 'r': y.r, 't': y.t, 'p': case y.k when 3 then {delete("p")} else x.p end,
    's': case y.k when 3 then least({delete("s")}, {keep("p", "s")}) else x.s end,
    'u': case y.k when 3 then least({delete("u")}, {into_u(lambda z: keep(z, "u"))}, {into_u(lambda z: rerole(z, "user"))}) when 1 then least(x.u, {into_u(lambda z: ins(z, "user"))}) else x.u end,
    'q': case y.k when 3 then least({delete("q")}, {keep("u", "a")}, {rerole("u", "assistant")}) when 2 then least(x.q, {ins("u", "assistant")}) else x.q end}}"""
    item = lambda k, f, r, t: f"{{'k': {k}, 'f': {f}, 'r': {r}, 't': {t}, 'p': {{'c': 0::bigint, 'a': '', 'o': ''}}, 's': {none}, 'u': {none}, 'q': {none}}}"
    empty = item("k", "0", "''", "''")
    return rf"""
with z as (select conv_id, turn::bigint as turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, row_number() over () as doc, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
crc as (select list(list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) order by i) as v from range(256) t(i)),
kz as (select z.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::bigint), lambda a, b: xor(a >> 8, crc.v[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 as k from z, crc),
r0 as (select conv_id, turn, role as by_role, sha256(text) as by_text, doc, unnest(case when k = 3 then [0, 1] else [0] end) as copy,
  case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from kz where k <> 0),
r1 as (select *, row_number() over (partition by conv_id order by turn nulls first, by_role, by_text, doc, copy) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as words from r0),
r2 as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen, lag(left(role, 1)) over (partition by conv_id order by i) as prior from r1),
r3 as (select *, case when words = '' then 1 when seen then 2 when right(words, 1) not in ('.', '!', '?') then 3 else 0 end as fault from r2),
st as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 1)::int) as blank, sum((fault = 2)::int) as duplicate, sum((fault = 3)::int) as truncated,
  sum((i > 1 and prior || left(role, 1) not in ('su', 'ua', 'au'))::int) as illegal from r3 group by conv_id),
/* before each row and at the end: inserts of a user (1) and of an assistant (2); then the row (3) */
el as (select conv_id, i, k, {item("k", "fault", "role", "text")} as e from r3, (select unnest([1, 2, 3]) as k)
  union all select conv_id, 9223372036854775807, k, {empty} from st, (select unnest([1, 2]) as k)),
fo as (select conv_id, list_reduce(list(e order by i, k), lambda x, y: {step}, {empty.replace("'k': k", "'k': 0")}) as x from el group by conv_id),
be as (select conv_id, least(x.p, x.q) as b from fo)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.o, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join st on st.conv_id is not distinct from c.conv_id left join be on be.conv_id is not distinct from c.conv_id
"""


SQL = _sql()
