"""Connected components of an edge table by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component, for nodes with an edge to another.

    Each round every node with a smaller neighbour is hooked to its least one (partial sums first,
    so a hub costs one row per task), chains are followed to their roots by doubling, and edges are
    renamed by the roots; those within a tree are gone for the next round, so a star is done in
    one.  All of it stays in tables; the driver sees a few counts per round.  Nulls are no nodes.
    """
    spark = edges.sparkSession
    rest = stage(_distinct(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges")
    parts: list[DataFrame] = []
    while rest.limit(1).count():
        hooked = _rooted(stage(rest.groupBy("u").agg(F.min("v").alias("root")), "hooks"))
        ends = hooked.withColumnRenamed("u", "v").withColumnRenamed("root", "rv")
        renamed = rest.join(hooked, "u").join(ends, "v", "left").select(F.col("root").alias("x"), F.coalesce("rv", "v").alias("y"))
        left = stage(_distinct(renamed), "edges")
        discard(spark, rest)
        rest = left
        parts.append(hooked)
    discard(spark, rest)
    empty = spark.createDataFrame([], "node long, label long")
    if not parts:
        return empty
    # a root of one round may be hooked in a later one
    labels = parts[-1].select(F.col("u").alias("node"), F.col("root").alias("label"))
    for earlier in reversed(parts[:-1]):
        later = labels.select(F.col("node").alias("root"), "label")
        mine = earlier.join(later, "root", "left").select(F.col("u").alias("node"), F.coalesce("label", "root").alias("label"))
        labels = mine.unionAll(labels)
    whole = stage(labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct()), "labels")
    discard(spark, *parts)
    return whole


def _distinct(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of pairs (x, y) that differ."""
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _rooted(hooks: DataFrame) -> DataFrame:
    """(u, root) of (u, root) rows whose roots may be hooked themselves."""
    while True:
        up = hooks.select(F.col("u").alias("root"), F.col("root").alias("above"))
        moved = stage(hooks.join(up, "root", "left").select("u", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
        discard(hooks.sparkSession, hooks)
        hooks = moved.select("u", "root")
        if not moved.where("moved").limit(1).count():
            return hooks
