"""Spans found in text: byte offsets to code points, and their digest columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


class Points:
    """Code points before each byte of a block."""

    def __init__(self, buf: np.ndarray):
        self.upto = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])

    def of(self, doc_start: int, byte: int) -> int:
        return int(self.upto[byte] - self.upto[doc_start])


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> of the base spans, base_sha256, and all spans as a string."""
    base = F.filter(spans, lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]


def _is(kind: str):
    return lambda s: s["kind"] == kind


def outside(taken: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[int]:
    """Indexes of the spans of `more` that overlap none of `taken` and none chosen before them; `more` ascends by start. Sorted once and merged."""
    out, i, end = [], 0, -1
    taken = sorted(taken)
    reach = -1  # the furthest end of the taken spans that start before the one looked at
    for k, (a, b) in enumerate(more):
        while i < len(taken) and taken[i][0] <= a:
            reach = max(reach, taken[i][1])
            i += 1
        if a >= reach and a >= end and not (i < len(taken) and taken[i][0] < b):
            out.append(k)
            end = b
    return out
