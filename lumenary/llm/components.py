"""Contraction of large graphs in rounds of hooking and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.session import forget, materialise, maybe_broadcast

#: Edges up to which one task does what is left (a checked bound; the result is the same but for the choice of the roots).
ONE_TASK = 500_000


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent); a parent that is no node is a root."""
    while True:
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            parents = parents.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"))
        done = materialise(parents)
        up = done.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        if done.join(up, "parent").filter("up <> parent").isEmpty():
            return done.withColumnRenamed("parent", "root")
        parents = done


def relabel(edges: DataFrame, roots: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges (a, b[, w]) between the roots of their ends, a < b, once for each pair (with the least weight)."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = edges.join(ra, "a", "left").join(rb, "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    out = out.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *([weight] if weight else [])).filter("a < b")
    return out.groupBy("a", "b").agg(F.min(weight).alias(weight)) if weight else out.distinct()


def _compose(labels: DataFrame | None, roots: DataFrame) -> DataFrame:
    if labels is None:
        return roots
    known = labels.withColumnRenamed("root", "mid").join(roots.select(F.col("node").alias("mid"), "root"), "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))
    return known.unionByName(roots.join(labels.select("node"), "node", "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is one node of its connected component, itself included.

    Each round every node that has a smaller neighbour hooks onto the smallest and the trees are contracted, so a path
    or a star of any size takes a number of rounds that grows with the logarithm of its size. Nulls are no nodes.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _contract(edges, None)


def choices(edges: DataFrame, both: DataFrame, weight: str = "w") -> tuple[DataFrame, DataFrame] | None:
    """((node, parent, w), (node, root)): the lightest edge of each node of `both` (a, b, w), ties by the ends, and the trees of these choices; None if there is
    no choice. Of two nodes that chose the same edge the lower one is a root, and so is a node without a choice.

    A tree under two nodes that chose each other is cut where a lighter edge leaves it: by then, in the order of the
    weights, the tree is part of something else. The cut nodes are in no tree. Away from the root the weights don't fall.
    """
    pick = F.min(F.struct(weight, F.least("a", "b"), F.greatest("a", "b"), F.col("b").alias("other")))
    best = materialise(both.groupBy("a").agg(pick.alias("m")).select(F.col("a").alias("node"), F.col("m.other").alias("parent"), F.col(f"m.{weight}").alias("w")))
    if best.isEmpty():
        return None
    back = best.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    roots = _roots(best.join(back, "parent", "left").filter("up is null or up <> node or node > parent").select("node", "parent"))
    leaving = turned(relabel(edges, roots, weight)).groupBy(F.col("a").alias("root")).agg(F.min(weight).alias("least"))
    leaving = leaving.join(best.select(F.col("node").alias("root")), "root", "left_semi")
    kept = roots.join(best, "node").join(leaving, "root", "left").filter("least is null or w <= least")
    return best, materialise(kept.select("node", "root"))


def turned(edges: DataFrame) -> DataFrame:
    """Edges (a, b, ...) in both directions."""
    return edges.unionByName(edges.withColumns({"a": F.col("b"), "b": F.col("a")}))


def united(a: list[int], b: list[int], n: dict[int, int], enough: float) -> list[tuple[int, int]]:
    """(node, root): edges in the given order join two components unless both have `enough` members. n: members of a node, 1 if not given."""
    parent = {v: v for v in [*a, *b]}
    size = {v: n.get(v, 1) for v in parent}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for x, y in zip(map(find, a), b, strict=True):
        x, y = find(x), find(y)
        if x != y and (size[x] < enough or size[y] < enough):
            x, y = (x, y) if size[x] >= size[y] else (y, x)
            parent[y] = x
            size[x] += size[y]
    return [(v, find(v)) for v in parent]


def _in_one_task(edges: DataFrame, weight: str | None, sizes: DataFrame | None, enough: int) -> DataFrame:
    """(node, root) of `edges`, ONE_TASK at most."""

    def run(edges: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(([weight] if weight else []) + ["a", "b"])
        n = dict(zip(sizes["node"].tolist(), sizes["n"].tolist(), strict=True))
        return pd.DataFrame(united(edges["a"].tolist(), edges["b"].tolist(), n, enough if weight and enough else float("inf")), columns=["node", "root"]).astype("int64")

    ends = maybe_broadcast(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * ONE_TASK)
    own = sizes.join(ends, "node", "left_semi").select("node", "n") if sizes is not None else edges.limit(0).select(F.col("a").alias("node"), F.lit(1).alias("n"))
    return edges.withColumn("g", F.lit(0)).groupBy("g").cogroup(own.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(run, "node long, root long")


def _contract(edges: DataFrame, weight: str | None, sizes: DataFrame | None = None, enough: int = 0) -> DataFrame:
    edges, labels = materialise(edges), None
    while left := edges.count():
        if left <= ONE_TASK:
            return materialise(_compose(labels, _in_one_task(edges, weight, sizes, enough)))
        if weight:
            both = turned(edges)
            if sizes is not None:
                both = both.join(sizes.filter(F.col("n") >= enough).select(F.col("node").alias("a")), "a", "left_anti")
            got = choices(edges, both, weight)
            if got is None:
                break
            roots = got[1]
        else:
            both = edges.withColumns({"a": F.col("b"), "b": F.col("a")})
            roots = _roots(both.groupBy("a").agg(F.min("b").alias("parent")).select(F.col("a").alias("node"), "parent"))
        labels = materialise(_compose(labels, roots))
        if sizes is not None:
            sizes = materialise(sizes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("node")).agg(F.sum("n").alias("n")))
        smaller = materialise(relabel(edges, roots, weight))
        forget(edges)
        edges = smaller
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.unionByName(labels.select("root").distinct().join(labels.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "root"))


def boruvka(edges: DataFrame, sizes: DataFrame | None = None, enough: int = 0) -> DataFrame:
    """(node, root): Borůvka's contraction along the lightest edge (a, b, w) of every component, ties by the ends.

    With sizes (node, n), a component of `enough` or more in all chooses no edge any more; others may still choose it.
    What is contracted are edges of the minimum spanning tree in an order that agrees with that of the weights (see
    `choices`): a component that has grown to `enough` holds no two parts of `enough` that single linkage would join to each other.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))
    return _contract(edges, "w", sizes, enough)
