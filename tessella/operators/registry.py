"""Operators as data. A column function gets its inputs' columns (logic also their tags) and its parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import across, cells, rolling
from . import grouped

NUMERIC = frozenset({"numeric", "weight", "port_return"})
TAGS = NUMERIC | {"group", "boolean", "broadcast", "object"}
ANY = None


@dataclass(frozen=True)
class Operator:
    name: str
    category: str
    inputs: tuple  # per input: a tag, a set of tags, or ANY
    result: str
    function: Callable
    takes_tags: bool = False
    masked: bool = True
    aggregate: Callable | None = None  # one value a date: an aggregate expression
    window: bool = False
    grouped: str | None = None  # by "symbol" or "date": function is one of Arrow batches

    def check(self, tags: list[str], params: dict) -> None:
        if len(tags) != len(self.inputs):
            raise TypeError(f"{self.name} takes {len(self.inputs)} inputs, not {len(tags)}")
        for i, (tag, want) in enumerate(zip(tags, self.inputs, strict=True)):
            if want is not ANY and tag != want and not (isinstance(want, frozenset) and tag in want):
                raise TypeError(f"{self.name}: input {i} is {tag}, not {want if isinstance(want, str) else sorted(want)}")
        if self.window:
            w = params.get("window")
            if not isinstance(w, int) or isinstance(w, bool) or w < 1:
                raise ValueError(f"{self.name}: window must be an integer of at least 1, not {w!r}")


REGISTRY: dict[str, Operator] = {}


def register_operator(name: str, function: Callable[..., Column], inputs: tuple, result: str = "numeric", category: str = "custom", **more) -> Operator:
    """Adds an operator; a name that is taken is an error."""
    if name in REGISTRY:
        raise RuntimeError(f"operator {name} is registered already")
    REGISTRY[name] = Operator(name, category, inputs, result, function, **more)
    return REGISTRY[name]


def register_grouped(name: str, function: Callable, inputs: tuple, by: str = "symbol", result: str = "numeric", category: str = "custom", **more) -> Operator:
    """Adds an operator whose function gets the Arrow batches of each symbol in order of time (or of each date); see grouped."""
    if by not in grouped.ORDER:
        raise ValueError(f"{name}: groups are by {' or '.join(grouped.ORDER)}, not {by}")
    if result not in grouped.KINDS:
        raise ValueError(f"{name}: no result {result}")
    return register_operator(name, function, inputs, result, category, grouped=by, **more)


def list_operators() -> list[str]:
    return sorted(f"{o.name} ({o.category})" for o in REGISTRY.values())


def list_operators_by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for o in sorted(REGISTRY.values(), key=lambda o: o.name):
        out.setdefault(o.category, []).append(o.name)
    return out


def _truths(f: Callable) -> Callable:
    def logic(*columns: Column, tags: list[str]) -> Column:
        for t in tags:
            if t == "broadcast":
                raise TypeError("logic takes no broadcast input")
        return f(*[cells.truth(c, t) for c, t in zip(columns, tags, strict=True)])

    return logic


for _name in ("mean", "std_dev", "max", "min", "sum", "delay", "delta", "count_nans", "product", "arg_max", "arg_min", "zscore", "rank"):
    register_operator(f"ts_{_name}", getattr(rolling, f"ts_{_name}"), ("numeric",), "numeric", "timeseries", window=True)
for _name in ("corr", "covariance"):
    register_operator(f"ts_{_name}", getattr(rolling, f"ts_{_name}"), ("numeric", "numeric"), "numeric", "timeseries", window=True)
for _name in ("any", "all"):
    register_operator(f"ts_{_name}", getattr(rolling, f"ts_{_name}"), ("boolean",), "boolean", "timeseries", window=True)

for _name in ("rank", "mean", "zscore", "scale"):
    register_operator(_name, getattr(across, _name), ("numeric",), "numeric", "crosssection")
register_operator("label_quantile", across.label_quantile, ("numeric",), "group", "crosssection")

for _name in ("rank", "max", "min", "sum", "neutralize", "scale", "scale_positive"):
    register_operator(f"group_{_name}", getattr(across, f"group_{_name}"), ("numeric", "group"), "numeric", "group")
register_operator("group_count", across.group_count, ("group",), "numeric", "group")

_REDUCE = {
    "cross_sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "cross_mean": F.avg,
    "cross_median": F.median,
    "cross_std": F.stddev_samp,
}
for _name, _f in _REDUCE.items():
    register_operator(_name, _f, (NUMERIC,), "broadcast", "reduction", masked=False, aggregate=_f)

for _name in ("add", "subtract", "multiply", "divide", "power"):
    register_operator(_name, getattr(cells, _name), (NUMERIC, NUMERIC), "numeric", "arithmetic")
for _name, _f in (("negate", cells.negate), ("abs", cells.absolute), ("log", cells.log), ("sign", cells.sign)):
    register_operator(_name, _f, (NUMERIC,), "numeric", "arithmetic")

for _name in ("greater_than", "less_than", "greater_or_equal", "less_or_equal", "equal", "not_equal"):
    register_operator(_name, getattr(cells, _name), (NUMERIC, NUMERIC), "boolean", "logical")
register_operator("and", _truths(lambda a, b: a & b), (ANY, ANY), "boolean", "logical", takes_tags=True)
register_operator("or", _truths(lambda a, b: a | b), (ANY, ANY), "boolean", "logical", takes_tags=True)
register_operator("not", _truths(lambda a: ~a), (ANY,), "boolean", "logical", takes_tags=True)
register_operator("is_nan", cells.is_nan, (ANY,), "boolean", "logical")
register_operator("if_else", cells.if_else, ("boolean", ANY, ANY), "numeric", "conditional")
register_operator("map_values", cells.map_values, (ANY,), "object", "transformation")
register_operator("composite_group", cells.composite_group, (ANY, ANY), "group", "transformation")
register_operator("assign", cells.assign, (ANY, ANY), "object", "transformation")

register_operator("trade_when", rolling.trade_when, (ANY, NUMERIC, ANY), "numeric", "timeseries")
register_operator("jump_decay", rolling.jump_decay, (NUMERIC,), "numeric", "timeseries", window=True)
register_grouped("hump", grouped.fold(grouped.humped), (NUMERIC,), category="timeseries")
register_grouped("ts_decay", grouped.fold(grouped.decayed), (NUMERIC,), category="timeseries")
register_grouped("ts_delta_limit", grouped.fold(grouped.delta_limited), (NUMERIC, NUMERIC), category="timeseries")
for _name in ("kth_element", "ts_backfill", "last_diff_value"):
    register_operator(_name, getattr(rolling, _name), (NUMERIC,), "numeric", "timeseries", window=True)
register_operator("days_from_last_change", rolling.days_from_last_change, (NUMERIC,), "numeric", "timeseries")
register_operator("ts_regression", rolling.ts_regression, (NUMERIC, NUMERIC), "numeric", "timeseries", window=True)
register_grouped("group_backfill", grouped.by_day(grouped.backfilled), (NUMERIC, "group"), by="label", category="group")
register_operator("vector_neut", across.vector_neut, (NUMERIC, NUMERIC), "numeric", "crosssection")
for _name in ("hard_cap", "within_net", "within_gross"):
    register_operator(_name, getattr(across, _name), (NUMERIC,), "weight", "portfolio")
register_operator("fill_share", across.fill_share, (NUMERIC,), "object", "portfolio")
register_operator("filled", across.filled, (NUMERIC, "object"), "weight", "portfolio")
