"""Connected components of a link table, by contraction.

In every round each vertex hooks to its least neighbour, the hooks are shortened by
pointer jumping, and the links between what remains are distinct again. Labels end as
the least vertex of each component. Nothing is gathered: hubs are rows of joins whose
sides have exchanges of their own, so a hot vertex can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.llm.tables import stored
from holdwright.operators.skew import skewed_lookup


def _renamed(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """The column's vertices replaced by their parents, where they have one."""
    found = skewed_lookup(rows, parents.select(F.col("a").alias(column), F.col("parent").alias("found_parent")), [column], [column])
    return found.withColumn(column, F.coalesce("found_parent", column)).drop("found_parent")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) for every vertex that has a link to another one."""
    pairs = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges = stored(pairs)
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy("a").agg(F.min("b").alias("parent")).select("a", F.least("a", "parent").alias("parent")))
        for _ in range(2):
            parents = stored(_renamed(parents, parents, "parent"))
        if labels is None:
            labels = parents.select(F.col("a").alias("vertex"), F.col("parent").alias("component"))
        else:
            labels = stored(_renamed(labels, parents, "component"))
        moved = _renamed(_renamed(edges, parents, "a"), parents, "b").where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels
