"""Connected components of a graph given by its links, as a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import runtime


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b) -> (id, component) for every node of a link; component is the smallest id reached.

    Every round each node hangs itself under its smallest neighbour, takes over that one's own
    parent, and the links are carried over to the parents; links inside a tree vanish. Nodes with
    links at least halve each round. Rounds are tables in the shared folder. Sums per node are
    minima, so a node with very many links is combined before the shuffle."""
    edges = runtime.keep(_tidy(links.select("a", "b")))
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("low", "a").alias("parent")
        )
        parent = runtime.keep(parent)
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        roots = runtime.keep(parent.join(above, "parent").select("node", "root"))
        if labels is None:
            labels, stale = roots.select(F.col("node").alias("id"), F.col("root").alias("component")), None
        else:
            moved = roots.select(F.col("node").alias("component"), "root")
            stale = labels
            labels = runtime.keep(
                labels.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            )
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        carried = edges.join(at_a, "a").select("root_a", "b").distinct().join(at_b, "b")
        fewer = runtime.keep(_tidy(carried.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        for old in (edges, parent, *([stale] if hasattr(stale, "_kept_path") else [])):
            runtime.drop(old)
        edges = fewer
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
