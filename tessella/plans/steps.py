"""Every step of an expression with what it would earn: signal, weights, returns and PnL, anew for another scaler."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.registry import NUMERIC
from . import portfolio
from .panel import Panel


class Steps:
    """Steps of a panel's expression in the order of evaluation, inputs before what is made of them; the last is the panel itself. They are the
    panels that it was made of: nothing is evaluated again. Weights and returns among them count as they are; signals are weighed."""

    def __init__(self, session, panel: Panel, scaler: str | Callable | None = None, **params):
        self.session, self.panel = session, panel
        self.signals: list[Panel] = [p for p in panel.walk() if "const" not in p.spec]
        # a session of its own scaler, over the same frame
        self._scaler = session._scaler if scaler is None else session.scaler_of(scaler, **params)

    def __len__(self) -> int:
        return len(self.signals)

    def signal(self, step: int) -> Panel:
        return self.signals[step]

    def weights(self, step: int) -> Panel | None:
        """None of a step that is no number, or a return."""
        s = self.signals[step]
        if s.tag == "weight":
            return s
        return self.session.weigh(s, self._scaler) if s.tag in NUMERIC and s.tag != "port_return" else None

    def returns(self, step: int) -> Panel | None:
        if self.signals[step].tag == "port_return":
            return self.signals[step]
        w = self.weights(step)
        return None if w is None else self.session.to_portfolio_returns(w)

    def daily_pnl(self, step: int = -1) -> DataFrame | None:
        r = self.returns(step)
        return None if r is None else self.session.daily_pnl(r)

    def cumulative_pnl(self, step: int = -1) -> DataFrame | None:
        d = self.daily_pnl(step)
        return None if d is None else portfolio.cumulative_pnl(d)

    def with_scaler(self, scaler: str | Callable, **params) -> Steps:
        """The same steps under another scaler; signals are not evaluated again."""
        out = Steps.__new__(Steps)
        out.session, out.panel, out.signals, out._scaler = self.session, self.panel, self.signals, self.session.scaler_of(scaler, **params)
        return out
