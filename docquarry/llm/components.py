"""Connected components of a graph given as rows, by contraction under random priorities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import cut, prepare

#: Edges that one task finishes: 4 MB of them.
FINISH = 250_000


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place that the pairs connect it with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def finished(edges: DataFrame) -> DataFrame:
    """(n, to): for each node of a bounded number of edges (u, v) the least node that it is connected with, found in one task."""
    prepare(edges.sparkSession)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
        u, v = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
        nodes, place = np.unique(np.r_[u, v], return_inverse=True)
        root = spanning_roots(len(nodes), place[: len(u)], place[len(u) :])
        yield pd.DataFrame({"n": nodes, "to": nodes[root]})

    return edges.select("u", "v").coalesce(1).mapInPandas(solve, "n long, to long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node (a long) of an edge between two different nodes; component is the smallest node.

    Each round every node hooks onto its neighbour of least priority, if that is below its own; edges are then taken
    between the hooks. Priorities are hashes drawn anew each round, so the expected number of nodes falls by a constant
    factor: rounds grow with the logarithm of the graph, whatever its diameter, until what is left (FINISH edges at most) is
    finished in one task. Nothing is collected; a node with many neighbours is pre-aggregated by min and joined by plain
    equi-joins that Spark may split. Null nodes and loops are ignored; repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels, turn = None, 0

    def relabelled(hook: DataFrame) -> DataFrame:
        """labels after each root has moved along hook (n, to)."""
        if labels is None:
            return hook.select(F.col("n").alias("node"), F.col("to").alias("root"))
        moved = hook.select(F.col("n").alias("root"), "to")
        return cut(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")

    while n := edges.count():
        if n <= FINISH:
            labels = relabelled(cut(finished(edges), "finished"))
            break
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select("v", "u"))
        best = both.groupBy("n").agg(F.min(F.struct(rank("o").alias("p"), F.col("o").alias("id"))).alias("m"))
        own = F.struct(rank("n").alias("p"), F.col("n").alias("id"))
        hook = cut(best.select("n", F.when(F.col("m") < own, F.col("m.id")).otherwise(F.col("n")).alias("to")), "hooks")
        labels = relabelled(hook)
        at = hook.select(F.col("n").alias("u"), F.col("to").alias("x"))
        to = hook.select(F.col("n").alias("v"), F.col("to").alias("y"))
        edges = edges.join(at, "u").join(to, "v").where("x <> y")
        edges = cut(edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        turn += 1
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if turn == 0:
        return labels.select("node", F.col("root").alias("component"))
    least = cut(labels.groupBy("root").agg(F.min("node").alias("component")), "least")
    return cut(labels.join(least, "root").select("node", "component"), "components")
