"""Connected components of an edge table by contraction: nodes point at their least neighbour, trees become one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node reachable, for all nodes of edges (a, b), longs.

    In each round every node points at the least of itself and its neighbours, pointers are doubled until all
    end at a root, and the edges between different roots are the edges of the next round. So an edge inside a
    group is joined in one round only, however many rounds the others take. A hot node's neighbours meet in a
    partial minimum before the shuffle. Every step is written, so plans are short and lost tasks reread a table.
    """
    left, rounds = written(_between(edges), "edges"), []
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        rounds.append(_roots(written(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")))
        rest = written(_between(_relabelled(left, rounds[-1])), "edges")
        forget(left)
        left = rest
        if left.isEmpty():
            break
    forget(left)
    out = rounds.pop()
    while rounds:
        inner = rounds.pop()
        joined = written(_through(inner, out), "labels")
        forget(inner, out)
        out = joined
    return out


def grown(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label), as components gives them, after edges (a, b) more; only the edges between components are walked."""
    links = written(_between(_relabelled(edges, labels)), "edges")
    if links.isEmpty():
        forget(links)
        return labels
    upper = components(links)
    out = written(_through(labels, upper).union(upper.join(labels, "node", "left_anti").select("node", "label")), "labels")
    forget(links, upper)
    return out


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges between the labels of their nodes; a node without one stands for itself."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    out = edges.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    return out.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))


def _through(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """labels whose label has a label in upper get that one."""
    beyond = upper.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
    return labels.join(beyond, "label", "left").select("node", F.coalesce("beyond", "label").alias("label"))


def _roots(pointers: DataFrame) -> DataFrame:
    """node and label, the end of its chain of pointers (node, label)."""
    while True:
        beyond = pointers.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        doubled = pointers.select("node", "label").join(beyond, "label")
        doubled = written(doubled.select("node", F.col("beyond").alias("label"), (F.col("beyond") != F.col("label")).alias("moved")), "labels")
        forget(pointers)
        pointers = doubled
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "label")
