"""Link graphs: spanning forests with transforms, components, descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkgrid.functions.rotations import Similarity


def least_labels(edges: DataFrame, checkpoint) -> DataFrame:
    """(v, c): the smallest vertex that v is connected with. checkpoint(DataFrame, name) writes and rereads a round."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        own = labels.select(F.col("v").alias("c"), F.col("c").alias("to"))
        after = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c")).join(own, "c", "left")
        labels = checkpoint(after.select("v", F.least("c", "to").alias("c"), (F.least("c", "to") < F.col("was")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("v", "c")


def keep_large(edges: DataFrame, faces: DataFrame, face: str, least: int, share: float, checkpoint) -> DataFrame:
    """Faces whose component has at least max(least, share of all) faces; faces without a neighbour are components of their own."""
    labels = least_labels(edges, checkpoint)
    named = faces.join(labels, F.col(face) == F.col("v"), "left").withColumn("component", F.coalesce("c", face)).drop("v", "c")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("faces"))
    total = sizes.agg(F.sum("faces").alias("total"))
    big = sizes.crossJoin(total).where(F.col("faces") >= F.greatest(F.lit(least), F.col("total") * share)).select("component", "faces")  # total: one row
    return named.join(big, "component")


def descend(tree: DataFrame, roots: list, checkpoint, child: str = "pid", parent: str = "ppid") -> DataFrame:
    """(child, depth): the roots' transitive children and how far below the nearest root they are. Each row of the tree has one parent.

    Every row looks at an ancestor, and each round at that one's ancestor, so a tree of any depth takes as many rounds as its depth
    has binary digits; rows in loops or below no root never arrive. checkpoint(DataFrame, name) writes and rereads a round.
    """
    depth = F.when(F.col(child).isin(roots), F.lit(0).cast("long"))
    state = checkpoint(tree.select(F.col(child).alias("v"), F.col(parent).alias("up"), F.lit(1).cast("long").alias("far"), depth.alias("depth")), "descent")
    for _ in range(state.count().bit_length() + 1):
        above = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("depth").alias("depth2"))
        moved = state.where("depth is null").join(above, "up")  # an ancestor that isn't there leads nowhere
        moved = moved.select("v", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("far") + F.col("depth2")).alias("depth"))
        state = checkpoint(state.where("depth is not null").unionByName(moved), "descent")
        if state.where("depth is null").isEmpty():
            break
    return state.where("depth is not null").select(F.col("v").alias(child), F.col("depth").cast("int").alias("depth"))


def spanning_forest(models: list[tuple[str, int]], edges: list[tuple[str, str, int, Similarity]]) -> dict[str, tuple[str, Similarity]]:
    """For each model its root, the largest of its tree, and the similarity into the root's frame.

    models: (name, images); edges: (a, b, inliers, transform of b into a). Edges join by falling inliers where they connect
    two trees. A scene has as many models as flights, so this small table is worked on where it is gathered.
    """
    parent = {m: m for m, _ in models}
    near: dict[str, list[tuple[str, Similarity]]] = {m: [] for m, _ in models}

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _, t in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            parent[find(b)] = find(a)
            near[a].append((b, t))
            near[b].append((a, t.inverse()))
    out: dict[str, tuple[str, Similarity]] = {}
    for root, _ in sorted(models, key=lambda m: (-m[1], m[0])):
        if root in out:
            continue
        out[root] = (root, Similarity(1.0, np.eye(3), np.zeros(3)))
        todo = [root]
        while todo:
            at = todo.pop()
            for other, t in near[at]:
                if other not in out:
                    out[other] = (root, out[at][1].compose(t))
                    todo.append(other)
    return out
