"""Cross-section: all symbols of a date, or those of a date that share a label."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def day() -> WindowSpec:
    return Window.partitionBy("date")


def peers(g: Column) -> WindowSpec:
    return Window.partitionBy("date", g)


def _rank(x: Column, keys: list) -> Column:
    """Average rank over the count, in (0, 1]."""
    p = Window.partitionBy(*keys)
    order = p.orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # the rows of equal value: the same sort, no shuffle by value
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count(x).over(p))


def rank(x: Column) -> Column:
    return _rank(x, ["date"])


def mean(x: Column, demean: bool = False) -> Column:
    m = F.avg(x).over(day())
    return x - m if demean else m


def zscore(x: Column) -> Column:
    return (x - F.avg(x).over(day())) / F.nullif(F.stddev_samp(x).over(day()), F.lit(0.0))


def _scaled(x: Column, w: WindowSpec, long: float, short: float) -> Column:
    up, down = F.sum(F.when(x > 0, x)).over(w), F.sum(F.when(x < 0, x)).over(w)
    any_x = F.count(F.when(x != 0, x)).over(w) > 0
    fits = F.when(x > 0, x / F.nullif(up, F.lit(0.0)) * long).when(x < 0, x / F.nullif(F.abs(down), F.lit(0.0)) * abs(short)).otherwise(x)
    if long:
        fits = F.when(any_x & up.isNull(), F.raise_error(F.lit("scale: no positive value for the long target"))).otherwise(fits)
    if short:
        fits = F.when(any_x & down.isNull(), F.raise_error(F.lit("scale: no negative value for the short target"))).otherwise(fits)
    return fits


def scale(x: Column, long: float = 1.0, short: float = -1.0) -> Column:
    """Positives to the sum long, negatives to the sum short; a date with one side only is an error unless the other target is 0."""
    return _scaled(x, day(), long, short)


def _edge(x: Column, share: float, n: Column, place: Column) -> Column:
    """Where the value at a share of the way from the least to the greatest of n lies: lo, hi and how far it is from lo to hi, 0 at a value itself."""
    at = (n - 1) * F.lit(share)
    near = F.when(F.abs(place - 1 - at) < 1, x.cast("double"))
    return F.struct((at % 1).alias("far"), F.min(near).over(day()).alias("lo"), F.max(near).over(day()).alias("hi"))


def _interpolated(e: Column) -> Column:
    """By a fused multiply-add, as DuckDB does it: where lo and hi are next to one another, as sums of the same values in another order are, the last bit says on which side of
    the edge they lie."""
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), e["lo"], 1 - e["far"], e["hi"] * e["far"]).cast("double")
    return F.when((e["far"] > 0) & e["lo"].isNotNull(), fused).otherwise(e["lo"]) + F.lit(0.0)  # no negative zero: array_distinct tells it from 0


def label_quantile(x: Column, bins: int, labels: list[str]) -> Column:
    """Labels of equal-count bins with right-closed, linearly interpolated edges; ranks decide where values are too few or edges equal."""
    if len(labels) != bins:
        raise ValueError(f"{bins} bins need {bins} labels, not {len(labels)}")
    w = day()
    order = w.orderBy(x.asc_nulls_last())
    n, distinct = F.count(x).over(w), F.max(F.when(x.isNotNull(), F.dense_rank().over(order))).over(w)
    edges = F.transform(F.array(*[_edge(x, i / bins, n, F.row_number().over(order)) for i in range(bins + 1)]), _interpolated)
    by_rank = F.least(F.floor(F.rank().over(order) * bins / F.nullif(n, F.lit(0))), F.lit(bins - 1))
    # missing where edges are equal; a list of the one list of edges, as these are to be made once a cell
    by_edge = F.transform(F.array(edges), lambda es: F.when(F.size(F.array_distinct(es)) > bins, F.greatest(F.size(F.filter(es, lambda e: e < x)) - 1, F.lit(0))))[0]
    bin_ = F.when(distinct == 1, 0).when(distinct < bins, by_rank).otherwise(F.coalesce(by_edge, by_rank))
    return F.when(x.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in labels]), (bin_ + 1).cast("int")))


def _labelled(x: Column, g: Column, e: Column) -> Column:
    return F.when(x.isNotNull() & g.isNotNull(), e)


def group_rank(x: Column, g: Column) -> Column:
    return F.when(g.isNotNull(), _rank(x, ["date", g]))


def group_max(x: Column, g: Column) -> Column:
    return _labelled(x, g, F.max(x).over(peers(g)))


def group_min(x: Column, g: Column) -> Column:
    return _labelled(x, g, F.min(x).over(peers(g)))


def group_sum(x: Column, g: Column) -> Column:
    return _labelled(x, g, F.sum(x).over(peers(g)))


def group_count(g: Column) -> Column:
    return F.when(g.isNotNull(), F.count(g).over(peers(g)).cast("double"))


def group_neutralize(x: Column, g: Column) -> Column:
    return _labelled(x, g, x - F.avg(x).over(peers(g)))


def group_scale(x: Column, g: Column, long: float = 1.0, short: float = -1.0) -> Column:
    return F.when(g.isNotNull(), _scaled(x, peers(g), long, short))


def group_scale_positive(x: Column, g: Column) -> Column:
    """Share of the group's sum; a negative value anywhere, with a label or without, is an error."""
    share = x / F.nullif(F.sum(x).over(peers(g)), F.lit(0.0))
    return F.when(x < 0, F.raise_error(F.lit("group_scale_positive: negative value"))).when(g.isNotNull(), share)


def vector_neut(x: Column, y: Column) -> Column:
    """x less its projection on y by date, over cells that have both; x where y is zero everywhere."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return a - F.coalesce(b * F.sum(a * b).over(day()) / F.nullif(F.sum(b * b).over(day()), F.lit(0.0)), F.lit(0.0))


def hard_cap(w: Column, limit: float) -> Column:
    """Weights of at most `limit` in size; what is cut off is lost."""
    return F.when(F.abs(w) > limit, F.signum(w) * limit).otherwise(w)


def fill_share(w: Column, limit: float) -> Column:
    """Of each position, by date and side in order of size: its place, and what the rest would be scaled by if all larger ones were capped, where that keeps it within the limit."""
    size = F.abs(w)
    side = Window.partitionBy("date", F.signum(w))
    rank = F.row_number().over(side.orderBy(size.desc_nulls_last(), "symbol"))
    # a sum up to the end is one from the start of the opposite order: Spark adds up a frame to the end anew for every row
    rest = F.sum(size).over(side.orderBy(size.asc_nulls_first(), F.desc("symbol")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scale = (F.sum(size).over(side) - (rank - 1) * limit) / F.nullif(rest, F.lit(0.0))
    return F.when(scale * size <= limit * (1 + 1e-12), F.struct(rank.alias("i"), scale.alias("f")))


def filled(w: Column, share: Column, limit: float) -> Column:
    """Weights of at most `limit`: the first share of fill_share scales its side, and larger positions are capped; all of them where there is none."""
    f = F.min(share).over(Window.partitionBy("date", F.signum(w)))["f"]
    return F.when(w.isNotNull(), F.signum(w) * F.least(F.lit(limit), F.coalesce(f * F.abs(w), F.lit(limit)))) if limit > 0 else w * 0.0


def within_net(w: Column, net: float) -> Column:
    """Weights whose sum by date is within +- net: the larger side is scaled down to it."""
    up = F.coalesce(F.sum(F.when(w > 0, w)).over(day()), F.lit(0.0))
    down = F.coalesce(-F.sum(F.when(w < 0, w)).over(day()), F.lit(0.0))
    return F.when((w > 0) & (up - down > net), w * (down + net) / F.nullif(up, F.lit(0.0))).when((w < 0) & (down - up > net), w * (up + net) / F.nullif(down, F.lit(0.0))).otherwise(w)


def within_gross(w: Column, gross: float) -> Column:
    """Weights whose sum of sizes by date is at most gross: all are scaled."""
    total = F.sum(F.abs(w)).over(day())
    return F.when(total > gross, w * gross / total).otherwise(w)
