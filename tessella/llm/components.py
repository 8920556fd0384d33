"""Connected components of a link table, distributed: nodes hook to their least neighbour, pointers are jumped, links contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster


def components(links: DataFrame, scratch: cluster.Scratch) -> DataFrame:
    """links: a, b (long). Returns node, root for every node that is not itself the least of its component; a table of scratch.

    Rounds grow with the logarithm of a component's diameter; each round's tables are deleted at the end. A node that a third of the links
    meet is a hot key of the joins' left sides alone, which Spark's adaptive execution splits; aggregates combine on the map side.
    """
    with cluster.Scratch(links.sparkSession) as rounds:
        return scratch.table(_components(links, rounds))


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _jump(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))


def _components(links: DataFrame, scratch: cluster.Scratch) -> DataFrame:
    links = scratch.table(_ordered(links))
    found: DataFrame | None = None
    while links.count():
        # a parent is less than its node, so jumping ends at roots
        parents = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        while True:
            parents = scratch.table(_jump(parents))
            if not parents.filter("moved").limit(1).count():
                break
        roots = parents.select("node", F.col("parent").alias("root"))
        if found is not None:  # what were roots now have roots themselves
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(roots)
        found = scratch.table(found) if found is not None else roots
        for end in "ab":
            links = links.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        links = scratch.table(_ordered(links))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def first_of(row: str = "row", id_col: str = "doc_id") -> list:
    """The order in which rows of a component are kept: rows with an id, then the least id, then the first row."""
    return [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row")]


def named(each: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """each (rows with the column key) with `best`, the first row of its component; distinct: key, best (first_of); roots: node, root."""
    rooted = distinct.join(roots.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("root"), F.col("best").alias("own"))
    least = rooted.groupBy("root").agg(F.min("own").alias("best"))
    return cluster.materialize(each.join(rooted.join(least, "root").select(key, "best"), key))
