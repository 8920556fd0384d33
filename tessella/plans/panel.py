"""A panel: one column of a session's frame, with its tag and where it comes from."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import across, cells

if TYPE_CHECKING:
    import pandas as pd

    from .session import Session


@dataclass(frozen=True)
class Step:
    step: int
    expr: str
    panel: Panel

    def to_df(self) -> DataFrame:
        return self.panel.to_df()


class Panel:
    __hash__ = None  # == gives a panel

    def __init__(self, session: Session, name: str | None, tag: str, step: int, expr: str, spec: dict, cache: list[Step] | None = None, cached: bool = False, aggregate: Column | None = None, inputs: list[Panel] | None = None):
        self.session, self.name, self.tag, self.step, self.expr, self.spec = session, name, tag, step, expr, spec
        self.cache, self.cached, self._aggregate, self.inputs = cache or [], cached, aggregate, inputs or []
        self._kept: DataFrame | None = None

    def on_grid(self) -> Column:
        """The column in the session's frame; one value a date is the aggregate over that date."""
        if self.name is None:
            self.name = self.session.column(cells.clean(self._aggregate.over(across.day())), masked=False)
        return F.col(self.name)

    def to_df(self) -> DataFrame:
        """date, symbol, value over the grid; date, value of one value a date. A recorded output is kept once it was asked for."""
        if not self.cached:
            return self._df()
        if not any(self._kept is k for k in self.session._kept):
            self._kept = self._df().persist()
            self.session._kept.append(self._kept)
        return self._kept

    def _df(self) -> DataFrame:
        if self._aggregate is not None:
            return self.session.frame(self).groupBy("date").agg(cells.clean(self._aggregate).alias("value"))
        return self.session.frame(self).select("date", "symbol", F.col(self.name).alias("value"))

    def to_wide_df(self, symbols: list) -> DataFrame:
        """A row a date and a column for each of these symbols, as a Spark frame to write or to go on with."""
        return self.to_df().groupBy("date").pivot("symbol", symbols).agg(F.first("value"))

    def to_wide(self) -> pd.DataFrame:
        """A pandas frame of dates by symbols, in the driver."""
        long = self.to_df().toPandas()
        return long.pivot(index="date", columns="symbol", values="value").sort_index() if "symbol" in long else long.set_index("date")[["value"]].sort_index()

    def to_numpy(self):
        return self.to_wide().to_numpy()

    def get_cached_step(self, step: int) -> DataFrame | None:
        return next((c.to_df() for c in self.cache if c.step == step), self.to_df() if self.cached and self.step == step else None)

    def list_cached_steps(self) -> list[int]:
        return sorted({c.step for c in self.cache} | ({self.step} if self.cached else set()))

    def to_json(self) -> str:
        """The spec as text; weights of a scaler without a name cannot be said."""
        if any(p.spec.get("op") == "weights" and not p.spec["params"].get("scaler") for p in self.walk()):
            raise ValueError("a scaler without a name has no place in JSON")
        return json.dumps(self.spec)

    def walk(self) -> list[Panel]:
        """The panels of this one's expression, inputs before what is made of them, each once; the last is this one."""
        out: list[Panel] = []
        stack: list[tuple[Panel, bool]] = [(self, False)]
        while stack:
            p, ready = stack.pop()
            if any(p is q for q in out):
                continue
            if ready:
                out.append(p)
            else:
                stack += [(p, True), *[(q, False) for q in reversed(p.inputs)]]
        return out

    def __repr__(self) -> str:
        return f"Panel({self.expr}: {self.tag}, step {self.step})"

    # ---- forms with operators ----

    def _two(self, name: str, other, swap: bool = False) -> Panel:
        return self.session.binary(name, other, self) if swap else self.session.binary(name, self, other)

    def __add__(self, o):
        return self._two("add", o)

    def __radd__(self, o):
        return self._two("add", o, True)

    def __sub__(self, o):
        return self._two("subtract", o)

    def __rsub__(self, o):
        return self._two("subtract", o, True)

    def __mul__(self, o):
        return self._two("multiply", o)

    def __rmul__(self, o):
        return self._two("multiply", o, True)

    def __truediv__(self, o):
        return self._two("divide", o)

    def __rtruediv__(self, o):
        return self._two("divide", o, True)

    def __pow__(self, o):
        return self._two("power", o)

    def __rpow__(self, o):
        return self._two("power", o, True)

    def __neg__(self):
        return self.session.ops.negate(self)

    def __abs__(self):
        return self.session.ops.abs(self)

    def __gt__(self, o):
        return self._two("greater_than", o)

    def __lt__(self, o):
        return self._two("less_than", o)

    def __ge__(self, o):
        return self._two("greater_or_equal", o)

    def __le__(self, o):
        return self._two("less_or_equal", o)

    def __eq__(self, o):
        return self._two("equal", o)

    def __ne__(self, o):
        return self._two("not_equal", o)

    def __and__(self, o):
        return getattr(self.session.ops, "and")(self, o)

    def __or__(self, o):
        return getattr(self.session.ops, "or")(self, o)

    def __invert__(self):
        return getattr(self.session.ops, "not")(self)

    def where(self, mask: Panel, value) -> Panel:
        """This panel with value wherever mask is true or missing."""
        return self.session.ops.assign(self, mask, value=value)


def dependencies(spec: dict) -> set[str]:
    """Fields that a spec reads."""
    return {spec["field"]} if "field" in spec else set().union(*[dependencies(a) for a in spec.get("args", [])]) if "args" in spec else set()
