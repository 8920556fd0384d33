"""A session: source, universe, operators, scaler and back-test over one frame.

Fields and results are columns of one long frame (date, symbol, t, in_universe, ...). The frame is made when it is asked for: the rows of
the grid and of all fields, those of one source read once, are laid under each other, dealt by symbol in one exchange, and made cells there;
forward fill and the time axis need no other. An operator only adds a column, so a chain of them is one plan: windows with the same
partitioning share their exchange and sort, and what a result does not use is pruned.
Sessions do not change what panels mean: `with_universe` gives a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, rolling
from ..operators.grouped import KINDS, grouped_column
from ..operators.registry import NUMERIC, REGISTRY, Operator
from ..sources.catalog import Catalog
from ..sources.fields import load_rows, source_of
from . import ic, ledger, portfolio, turnover
from .factors import by_date, residual
from .grid import calendar, grid
from .panel import Panel, Step
from .steps import Steps


#: Cells of the grid that a task of the time axis holds, on average.
CELLS = 250_000


class _Ops:
    """Registered operators as methods; those whose names are keywords by getattr."""

    def __init__(self, session: Session):
        self._session = session

    def __getattr__(self, name: str) -> Callable[..., Panel]:
        if name not in REGISTRY:
            raise AttributeError(f"no operator {name}")
        return lambda *inputs, **params: self._session.apply(REGISTRY[name], inputs, params)

    def constant(self, value) -> Panel:
        return self._session.constant(value)

    def __dir__(self):
        return sorted(REGISTRY)


class Session:
    def __init__(self, catalog: Catalog, universe: str | DataFrame, start: Date | str | None = None, end: Date | str | None = None, returns: str = "returns", buffer_days: int = 0, member: Column | None = None):
        """universe: a field whose observed cells are the universe (those for which member, over date, symbol and value, is true), or a frame
        date, symbol, in_universe. No end is an open one."""
        self.catalog, self.start, self.end, self.returns_field, self.buffer_days = catalog, start, end, returns, buffer_days
        self._member, self._sources = member, []  # fields that the frame reads, the universe's first
        if isinstance(universe, str):
            self._sources.append(universe)
            self._cells, known = None, load_rows(catalog, [universe], start, end)
        else:
            self._cells = known = universe.select("date", "symbol", F.coalesce(F.col("in_universe").cast("boolean"), F.lit(True)).alias("in_universe")).filter("date is not null and symbol is not null")
        self._dates = calendar(known)
        self._symbols = known.select("symbol").distinct()
        self._n_symbols: int | None = None
        self._steps: list[tuple[str, Column | Callable[[DataFrame], DataFrame]]] = []  # columns added so far, or what adds them to the frame, in order
        self._fixed: tuple[DataFrame, int] | None = None
        self._fixed_sources: list[str] = []
        self._built: tuple[int, int, DataFrame] | None = None
        self._names = 0
        self._kept: list[DataFrame] = []  # recorded outputs
        self._fields: dict[str, Panel] = {}
        self._always: set[str] = set()  # columns that the mask is made of
        self._masking: list[Panel] = []
        self._scaler: Callable[[Column], Column] | None = None
        self.ops = _Ops(self)

    # ---- columns ----

    def _read(self, names: list[str], member: bool) -> DataFrame:
        """date, symbol, t (and in_universe) of the grid, with the fields as columns _f_<name>."""
        groups: dict[tuple, list[str]] = {}
        for n in names:
            groups.setdefault(source_of(self.catalog.field(n)), []).append(n)
        parts, first = [grid(self._symbols, self._dates)], [F.max("t").alias("t")]
        for i, group in enumerate(groups.values()):
            columns = [f"_f_{n}" for n in group]
            rows = load_rows(self.catalog, group, self.start, self.end, self.buffer_days).withColumnsRenamed({n: f"_f_{n}" for n in group})
            parts.append(rows.withColumn(f"_row{i}", F.lit(True)))
            twice = F.count(f"_row{i}") > 1
            first += [F.when(twice, F.raise_error(F.lit(f"field {', '.join(group)}: two rows of one date and symbol"))).otherwise(F.first(c, ignorenulls=True)).alias(c) for c in columns]
            first.append(F.max(f"_row{i}").alias(f"_row{i}"))
        if member and self._cells is not None:
            parts.append(self._cells)
            first.append(F.max("in_universe").alias("in_universe"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        # dealt by symbol alone: what follows on the time axis is in place. Into tasks by cells, as bytes say little: a grid's empty cells are packed to nothing on the way
        df = every.repartition(self._tasks(), "symbol").groupBy("symbol", "date").agg(*first)
        if member and self._cells is None:
            value = F.col(f"_f_{self._sources[0]}")
            inside = value.isNotNull()
            if self._member is not None:
                df = df.withColumn("value", value)
                inside = inside & self._member
            df = df.withColumn("in_universe", inside).drop("value")
        if member:
            df = df.withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))
        filled = {}
        for i, group in enumerate(groups.values()):
            for n in group:
                fill = self.catalog.field(n).forward_fill
                if fill:
                    filled[f"_f_{n}"] = (rolling.forward_fill(F.col(f"_f_{n}"), "date") if fill == "value" else rolling.forward_fill_rows(F.col(f"_f_{n}"), F.col(f"_row{i}"), "date"))
        df = df.withColumns(filled) if filled else df
        kept = ["date", "symbol", "t", *(["in_universe"] if member else []), *[f"_f_{n}" for n in names]]
        return df.filter("t is not null").select(*kept)

    def _tasks(self) -> int:
        if self._n_symbols is None:
            self._n_symbols = self._symbols.count()
        return max(1, -(-self._n_symbols * len(self._dates) // CELLS))

    def frame(self, panel: Panel | None = None) -> DataFrame:
        """The frame with all fields and columns so far. With a panel, and where functions of batches add columns (which Catalyst cannot prune), with what
        the panel is made of alone."""
        if panel is not None and any(not isinstance(e, Column) for _, e in self._steps):
            return self._frame_of(panel)
        if self._built is None or self._built[0] != len(self._sources):
            late = [n for n in self._sources if n not in self._fixed_sources]
            if self._fixed is None:
                df, done = self._read(self._sources, True), 0
            else:
                df, done = self._fixed[0], self._fixed[1]
                if late:
                    df = df.join(self._read(late, False).drop("t"), ["date", "symbol"], "left")
            self._built = (len(self._sources), done, df)
        n, done, df = self._built
        for name, e in self._steps[done:]:
            df = df.withColumn(name, e) if isinstance(e, Column) else e(df)
        self._built = (n, len(self._steps), df)
        return df

    def _frame_of(self, panel: Panel) -> DataFrame:
        made = panel.walk()
        if self._always:  # fields that the mask is made of
            made = [*made, *self._masking]
        names, fields = {p.name for p in made}, [p.spec["field"] for p in made if "field" in p.spec]
        if self._fixed is None:
            df, done = self._read(list(dict.fromkeys([*self._sources[:1], *fields])), True), 0
        else:
            df, done = self._fixed
            late = [n for n in dict.fromkeys(fields) if n not in self._fixed_sources]
            df = df.join(self._read(late, False).drop("t"), ["date", "symbol"], "left") if late else df
        for name, e in self._steps[done:]:
            if name in names or name in self._always:
                df = df.withColumn(name, e) if isinstance(e, Column) else e(df)
        return df

    def _name(self) -> str:
        self._names += 1
        return f"c{self._names}"

    def column(self, e: Column, masked: bool = True) -> str:
        name = self._name()
        self._steps.append((name, F.when(F.col("in_universe"), e) if masked else e))
        return name

    def grouped(self, op: Operator, columns: list[Column], params: dict, result: str) -> str:
        """A column that a grouped operator's function adds to the frame."""
        name = self._name()
        value = F.col(name) if result != "numeric" else _clean(F.col(name), result)
        masked = F.when(F.col("in_universe"), value) if op.masked else value
        self._steps.append((name, lambda df: grouped_column(df, name, op.function, op.grouped, columns, params, KINDS[result]).withColumn(name, masked)))
        return name

    def persist(self) -> Session:
        """Keeps the frame as it is, so that results share what they have in common, until `release`."""
        df = self.frame().persist()
        self._fixed, self._fixed_sources = (df, len(self._steps)), list(self._sources)
        self._built = (len(self._sources), len(self._steps), df)
        return self

    def release(self) -> Session:
        """Frees what `persist` and recorded outputs keep; results are the same, computed anew."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        if self._fixed is not None:
            self._fixed[0].unpersist()
            self._fixed, self._fixed_sources, self._built = None, [], None
        return self

    # ---- inputs ----

    def field(self, name: str) -> Panel:
        """A field on the grid, outside of the universe missing; loaded once a session."""
        if name not in self._fields:
            spec = self.catalog.field(name)
            tag = spec.tag
            if name not in self._sources:
                self._sources.append(name)
            self._fields[name] = Panel(self, self.column(F.col(f"_f_{name}")), tag, 0, f"Field({name})", {"field": name})
        return self._fields[name]

    __call__ = field

    def clear_cache(self) -> None:
        """Forgets the fields and frees what is kept. Columns that no result uses cost nothing."""
        self._fields.clear()
        self.release()

    def list_cached_fields(self) -> list[str]:
        return sorted(self._fields)

    def constant(self, value) -> Panel:
        """The value in every cell, outside of the universe as well."""
        tag = "boolean" if isinstance(value, bool) else "numeric" if isinstance(value, (int, float)) else "group"
        e = F.lit(float(value) if tag == "numeric" else value)
        return Panel(self, self.column(e, masked=False), tag, 0, f"Constant({value!r})", {"const": value})

    # ---- operators ----

    def apply(self, op: Operator, inputs, params: dict) -> Panel:
        params = dict(params)
        record = params.pop("record_output", False)
        panels = [x if isinstance(x, Panel) else self.constant(x) for x in inputs]
        if any(p.session is not self for p in panels):
            raise ValueError(f"{op.name}: an input belongs to another session")
        tags = [p.tag for p in panels]
        op.check(tags, params)
        if any(t == "broadcast" for t in tags) and op.category not in ("arithmetic", "logical"):
            raise TypeError(f"{op.name} takes no broadcast input")
        columns = [p.on_grid() for p in panels]
        result = op.result
        if op.name == "if_else":
            result = next((p.tag for p in panels[1:] if "const" not in p.spec), "numeric")
        elif op.name in ("assign", "map_values"):
            result = tags[0] if op.name == "assign" else ("numeric" if params.get("mapping") and all(isinstance(v, (int, float)) for v in params["mapping"].values()) else tags[0])
        said = {k: [list(kv) for kv in v.items()] if isinstance(v, dict) else v for k, v in params.items()}  # JSON has text keys alone
        spec = {"op": op.name, "args": [p.spec for p in panels], "params": said}
        text = f"{op.name}({', '.join([p.expr for p in panels] + [f'{k}={v!r}' for k, v in params.items()])})"
        step = max((p.step for p in panels), default=-1) + 1
        cache = [c for p in panels for c in p.cache] + [Step(p.step, p.expr, p) for p in panels if p.cached]
        if op.aggregate:
            return Panel(self, None, "broadcast", step, text, spec, cache, record, aggregate=op.aggregate(columns[0]), inputs=panels)
        if op.grouped:
            return Panel(self, self.grouped(op, columns, params, result), result, step, text, spec, cache, record, inputs=panels)
        e = op.function(*columns, **params, **({"tags": tags} if op.takes_tags else {}))
        return Panel(self, self.column(_clean(e, result), op.masked), result, step, text, spec, cache, record, inputs=panels)

    def binary(self, name: str, a, b) -> Panel:
        """Dunder arithmetic and comparison: keeps the type of the side that is no broadcast; masked like every operator."""
        panels = [x if isinstance(x, Panel) else self.constant(x) for x in (a, b)]
        op = REGISTRY[name]
        kept = next((p.tag for p in panels if p.tag != "broadcast" and "const" not in p.spec), panels[0].tag)
        for p in panels:
            if p.tag not in NUMERIC | {"broadcast"} and not (name in ("equal", "not_equal") and p.tag in ("group", "object", "boolean")):
                raise TypeError(f"{name} does not take {p.tag}")
        e = op.function(*[p.on_grid() for p in panels])
        tag = "boolean" if op.result == "boolean" else kept
        cache = [c for p in panels for c in p.cache] + [Step(p.step, p.expr, p) for p in panels if p.cached]
        return Panel(self, self.column(_clean(e, tag)), tag, max(p.step for p in panels) + 1, f"{name}({', '.join(p.expr for p in panels)})", {"op": name, "args": [p.spec for p in panels], "params": {}, "form": "symbol"}, cache, inputs=panels)

    def _together(self, *panels: Panel) -> DataFrame:
        """The frame with what these panels are made of."""
        for p in panels:
            p.on_grid()
        return self.frame(Panel(self, None, "object", 0, "", {}, inputs=list(panels)))

    def factor_regression(self, y: Panel, factors: list[Panel], intercept: bool = True) -> tuple[DataFrame, Panel]:
        """By date: n, rank, alpha, betas, r2 of y on the factors; and the residuals as a panel."""
        solved = by_date(self._together(y, *factors), y.on_grid(), [f.on_grid() for f in factors], intercept)
        name, given = self._name(), [f.on_grid() for f in factors]
        self._steps.append((name, lambda df: residual(df, solved, name, y.on_grid(), given)))
        spec = {"op": "factor_residual", "args": [y.spec, *[f.spec for f in factors]], "params": {"intercept": intercept}}
        text = f"factor_residual({', '.join(p.expr for p in (y, *factors))}, intercept={intercept!r})"
        return solved, Panel(self, name, "numeric", max(p.step for p in (y, *factors)) + 1, text, spec, inputs=[y, *factors])

    def cap_positions(self, weights: Panel, limit: float, trim: str = "proportional") -> Panel:
        """Weights of at most `limit` in size; proportional: what is cut off goes to the uncapped of the same side as far as their caps allow; hard: it is lost."""
        if trim not in ("proportional", "hard"):
            raise ValueError(f"no trim {trim}")
        if trim == "hard":
            return self.ops.hard_cap(weights, limit=limit)
        return self.ops.filled(weights, self.ops.fill_share(weights, limit=limit), limit=limit)

    def limit_leverage(self, weights: Panel, gross: float | None = None, net: float | None = None) -> Panel:
        """Weights within +- net in sum, then within gross in size."""
        out = weights if net is None else self.ops.within_net(weights, net=net)
        return out if gross is None else self.ops.within_gross(out, gross=gross)

    def ledger(self, weights: dict[str, Panel] | Panel, price: Panel, volume: Panel | None = None, **more) -> DataFrame:
        """Shares, cash and costs by day of one strategy or of several by name; see plans.ledger."""
        weights = weights if isinstance(weights, dict) else {"weights": weights}
        if any(w.tag != "weight" for w in weights.values()):
            raise TypeError("a ledger is of weights")
        frame = self._together(*weights.values(), price, *([volume] if volume is not None else []))
        return ledger.ledger(frame, {k: w.on_grid() for k, w in weights.items()}, price.on_grid(), volume.on_grid() if volume is not None else None, **more)

    def rank_ic(self, signal: Panel, price: Panel, horizons: list[int]) -> DataFrame:
        return ic.rank_ic(self._together(signal, price), signal.on_grid(), price.on_grid(), horizons)

    def ts_target_tvr_decay(self, x: Panel, lambda_min: float = 0.0, lambda_max: float = 1.0, target_tvr: float = 0.1, **search) -> Panel:
        """ts_decay with the weight of the range that brings x nearest to the target turnover; a job a round is run at once."""
        given = [x.on_grid()]
        weight, _ = turnover.search(self.frame(x), given, "ts_decay", lambda_min, lambda_max, target_tvr, **search)
        return self.ops.ts_decay(x, weight=weight)

    def ts_target_tvr_delta_limit(self, x: Panel, y, lambda_min: float = 0.0, lambda_max: float = 1.0, target_tvr: float = 0.1, **search) -> Panel:
        """ts_delta_limit by y with the weight of the range that brings x nearest to the target turnover."""
        y = y if isinstance(y, Panel) else self.constant(y)
        both = self.ops.ts_delta_limit(x, y)  # stands for what the two are made of
        weight, _ = turnover.search(self.frame(both), [x.on_grid(), y.on_grid()], "ts_delta_limit", lambda_min, lambda_max, target_tvr, **search)
        return self.ops.ts_delta_limit(x, y, weight=weight)

    # ---- universe ----

    def universe(self) -> DataFrame:
        return self.frame().select("date", "symbol", "in_universe")

    def universe_count(self) -> DataFrame:
        return self.frame().groupBy("date").agg(F.sum(F.col("in_universe").cast("int")).cast("long").alias("value"))

    def is_in_universe(self, date, symbol) -> bool:
        row = self.frame().filter((F.col("date") == F.lit(date).cast("date")) & (F.col("symbol") == F.lit(symbol))).select("in_universe").first()
        return bool(row and row["in_universe"])

    def with_universe(self, member: Panel) -> Session:
        """A session over the cells of this universe where member is true; it keeps source and scaler."""
        if member.tag != "boolean":
            raise TypeError(f"a universe is boolean, not {member.tag}")
        out = copy(self)  # the same grid, sources and columns; the mask changes behind them
        keep = F.coalesce(member.on_grid(), F.lit(False))
        out._steps = [*self._steps, ("in_universe", F.col("in_universe") & keep)]
        out._always = self._always | {p.name for p in member.walk()} | {"in_universe"}
        out._masking = [*self._masking, *member.walk()]
        out._sources, out._fields, out._kept = list(self._sources), {}, []
        out._fixed, out._fixed_sources, out._built, out.ops = None, [], None, _Ops(out)
        return out

    def restricted_to(self, universe: DataFrame) -> Session:
        """A session over the universe date, symbol, in_universe; one that would add a cell to this universe is an error."""
        new = universe.filter("in_universe").select("date", "symbol")
        if new.join(self.frame().filter("in_universe"), ["date", "symbol"], "left_anti").limit(1).count():
            raise ValueError("the new universe is no subset of the session's")
        out = Session(self.catalog, universe, self.start, self.end, self.returns_field, self.buffer_days)
        out._scaler = self._scaler
        return out

    # ---- portfolio ----

    @staticmethod
    def scaler_of(scaler: str | Callable, **params) -> portfolio.Scaler:
        """A name of portfolio.SCALERS, or a function of a column; parameters go to it."""
        if isinstance(scaler, portfolio.Scaler):
            return scaler
        if isinstance(scaler, str) and scaler not in portfolio.SCALERS:
            raise KeyError(f"no scaler {scaler}; there are {', '.join(sorted(portfolio.SCALERS))}")
        return portfolio.Scaler(scaler if isinstance(scaler, str) else None, portfolio.SCALERS[scaler] if isinstance(scaler, str) else scaler, params)

    def set_scaler(self, scaler: str | Callable, **params) -> Session:
        self._scaler = self.scaler_of(scaler, **params)
        return self

    def get_active_scaler(self) -> Callable[[Column], Column] | None:
        """What `set_scaler` set, as a function of a column."""
        return self._scaler

    def weigh(self, signal: Panel, scaler: Callable[[Column], Column] | None) -> Panel:
        if scaler is None:
            raise RuntimeError("no scaler is set")
        scaler = self.scaler_of(scaler)
        spec = {"op": "weights", "args": [signal.spec], "params": {"scaler": scaler.name, "with": scaler.params}}
        return Panel(self, self.column(cells.clean(scaler(signal.on_grid())), masked=False), "weight", signal.step + 1, f"weights({signal.expr})", spec, list(signal.cache), inputs=[signal])

    def to_weights(self, signal: Panel) -> Panel:
        return self.weigh(signal, self._scaler)

    def steps(self, panel: Panel, scaler: str | Callable | None = None, **params) -> Steps:
        """Signal, weights, returns and PnL of every step of the panel's expression."""
        return Steps(self, panel, scaler, **params)

    def _earned(self, weights: Panel, side: Column, name: str) -> Panel:
        if weights.tag != "weight":
            raise TypeError(f"returns are made of weights, not of {weights.tag}")
        ret = self.field(self.returns_field)
        before = F.when(F.col("in_universe"), rolling.ts_delay(side, 1))
        return Panel(self, self.column(cells.clean(before * ret.on_grid())), "port_return", weights.step + 1, f"{name}({weights.expr})", {"op": name, "args": [weights.spec], "params": {}}, list(weights.cache), inputs=[weights])

    def to_portfolio_returns(self, weights: Panel) -> Panel:
        """Yesterday's weight times today's return, where the symbol is in the universe today."""
        return self._earned(weights, weights.on_grid(), "returns")

    def to_long_returns(self, weights: Panel) -> Panel:
        w = weights.on_grid()
        return self._earned(weights, F.when(w > 0, w).otherwise(0.0), "long_returns")

    def to_short_returns(self, weights: Panel) -> Panel:
        w = weights.on_grid()
        return self._earned(weights, F.when(w < 0, w).otherwise(0.0), "short_returns")

    def daily_pnl(self, returns: Panel) -> DataFrame:
        return portfolio.daily_pnl(returns.to_df())

    # ---- expressions as JSON ----

    def evaluate(self, spec: dict) -> Panel:
        """The panel of a spec, as Panel.spec gives it."""
        if "field" in spec:
            return self.field(spec["field"])
        if "const" in spec:
            return self.constant(spec["const"])
        args = [self.evaluate(a) for a in spec["args"]]
        if spec["op"] == "weights":
            said = spec["params"]
            if said and not said.get("scaler"):
                raise ValueError("these weights were made by a scaler without a name")
            return self.weigh(args[0], self.scaler_of(said["scaler"], **said["with"])) if said else self.to_weights(args[0])  # specs of old say none: the active one
        if spec["op"] == "factor_residual":
            return self.factor_regression(args[0], args[1:], **spec["params"])[1]
        special = {"returns": self.to_portfolio_returns, "long_returns": self.to_long_returns, "short_returns": self.to_short_returns}
        if spec["op"] in special:
            return special[spec["op"]](*args)
        if spec["op"] not in REGISTRY:
            raise ValueError(f"no operator {spec['op']}")
        if spec.get("form") == "symbol":
            return self.binary(spec["op"], *args)
        params = {k: {a: b for a, b in v} if k == "mapping" and isinstance(v, list) else v for k, v in spec["params"].items()}
        return self.apply(REGISTRY[spec["op"]], args, params)


def _clean(e: Column, tag: str) -> Column:
    """A numeric result is missing where it would be NaN."""
    return cells.clean(e) if tag in NUMERIC else e
