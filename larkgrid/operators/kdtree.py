"""Exact nearest neighbours over a k-d tree of the reference whose leaves hold a few thousand points, however they are spread.

The tree's cuts come from a sample; its boxes from all points. Each probe position is first compared with its own leaf, which
bounds its distance, and then with the other leaves whose boxes lie within the bound. A task holds one leaf and a chunk of
probes. Points of one position are one probe; of a position's references only the first k by key can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

#: Reference positions of a leaf, sampled ones of a leaf, and probes that meet a leaf in one task.
LEAF, SAMPLE, CHUNK = 2048, 64, 8192
#: Distances that are held at once.
CELLS = 1 << 20
XYZ = ("x", "y", "z")


class Tree:
    def __init__(self, sample: np.ndarray, least: int):
        self.axis, self.cut, self.child, self.leaves = [], [], [], 0
        self.leaf: list[int] = []
        todo = [(np.unique(sample, axis=0), None)]
        while todo:
            points, parent = todo.pop()
            me = len(self.axis)
            if parent is not None:
                self.child[parent[0]][parent[1]] = me
            self.child.append([-1, -1])
            if len(points) <= max(least, 1):
                self.axis.append(0)
                self.cut.append(0.0)
                self.leaf.append(self.leaves)
                self.leaves += 1
                continue
            a = int(np.argmax(points.max(0) / 2 - points.min(0) / 2))
            v = points[:, a]
            cut = float(np.partition(v, len(v) // 2)[len(v) // 2])
            if cut == v.min():
                cut = float(v[v > cut].min())
            self.axis.append(a)
            self.cut.append(cut)
            self.leaf.append(-1)
            todo += [(points[v < cut], (me, 0)), (points[v >= cut], (me, 1))]
        self.axis, self.cut, self.child, self.leaf = np.array(self.axis), np.array(self.cut), np.array(self.child), np.array(self.leaf)

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        open_ = np.flatnonzero(self.leaf[node] < 0)
        while len(open_):
            at = node[open_]
            node[open_] = self.child[at, (points[open_, self.axis[at]] >= self.cut[at]).astype(int)]
            open_ = open_[self.leaf[node[open_]] < 0]
        return self.leaf[node]

    def bound(self, boxes: dict[int, tuple]) -> None:
        """Low and high corners of all nodes from those of the leaves."""
        self.low, self.high = np.full((len(self.leaf), 3), np.inf), np.full((len(self.leaf), 3), -np.inf)
        for i in range(len(self.leaf) - 1, -1, -1):
            if self.leaf[i] >= 0:
                if self.leaf[i] in boxes:
                    self.low[i], self.high[i] = boxes[self.leaf[i]][:3], boxes[self.leaf[i]][3:]
            else:
                self.low[i], self.high[i] = self.low[self.child[i]].min(0), self.high[self.child[i]].max(0)

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves that may hold something no farther than the radius."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            off = np.maximum(0.0, np.maximum(self.low[node] - points[at], points[at] - self.high[node]))
            near = np.sqrt((off**2).sum(1)) <= radius[at] * (1 + 1e-12)
            at, node = at[near], node[near]
            end = self.leaf[node] >= 0
            found.append((at[end], self.leaf[node[end]]))
            at, node = np.repeat(at[~end], 2), self.child[node[~end]].reshape(-1)
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (at, node)


def xyz(table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy() for n in names], 1).astype(float, copy=False)


def meet(probes: pa.Table, refs: pa.Table, k: int, keep: list[str], schema: pa.Schema) -> pa.Table:
    """The k nearest references of each probe within its bound r, ties by key; `lead` marks one row a probe, which holds the new bound."""
    if not probes.num_rows or not refs.num_rows:
        return schema.empty_table()
    refs = refs.take(pc.sort_indices(refs.column("rk"), null_placement="at_start"))
    q = xyz(refs, XYZ)
    order = np.lexsort((np.arange(len(q)), q[:, 2], q[:, 1], q[:, 0]))  # rows of a position stay in the order of their keys
    q = q[order]
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]).any(1)])
    size = np.diff(np.r_[first, len(q)])
    spots = q[first]
    p, r = xyz(probes, ("px", "py", "pz")), probes.column("r").to_numpy()
    step = max(1, CELLS // len(spots))
    who, row, far, ends = [], [], [], np.array(r, float)
    for a in range(0, len(p), step):
        part = p[a : a + step]
        d = (part[:, :1] - spots[:, 0]) ** 2
        d += (part[:, 1:2] - spots[:, 1]) ** 2
        d += (part[:, 2:] - spots[:, 2]) ** 2
        np.sqrt(d, out=d)
        edge = r[a : a + step].astype(float)
        if len(spots) > k:
            edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d <= edge[:, None])
        # all rows of these positions, then the first k of each probe
        n = size[j]
        rows = np.repeat(first[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(j) else np.zeros(0, int)
        i, dist = np.repeat(i, n), np.repeat(d[i, j], n)
        rank = order[rows]
        by = np.lexsort((rank, dist, i))
        i, dist, rank = i[by], dist[by], rank[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        ok = place < k
        i, dist, rank, place = i[ok], dist[ok], rank[ok], place[ok]
        last = place == k - 1
        ends[a + i[last]] = np.minimum(ends[a + i[last]], dist[last])
        who.append(a + i)
        row.append(rank)
        far.append(dist)
    who, row, far = np.concatenate(who), np.concatenate(row), np.concatenate(far)
    lead = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
    alone = np.setdiff1d(np.arange(len(p)), who)
    who, lead = np.r_[who, alone], np.r_[lead, np.ones(len(alone), bool)]
    none = len(alone)
    columns = {f"p{a}": pa.array(p[who, i]) for i, a in enumerate(XYZ)} | {"lead": pa.array(lead), "r": pa.array(ends[who])}
    columns["distance"] = pa.array(np.r_[far, np.zeros(none)], mask=np.arange(len(who)) >= len(far))
    index = pa.array(np.r_[row, np.zeros(none, np.int64)].astype(np.int64), mask=np.arange(len(who)) >= len(far))
    for c in ["rk", *keep]:
        columns[c] = refs.column(c).take(index)
    return pa.table([columns[f.name] for f in schema], schema=schema)


def nearest(probe: DataFrame, ref: DataFrame, key: str, ref_key: str, keep: list[str], k: int, most: float, checkpoint: Callable[[DataFrame, str], DataFrame] | None) -> DataFrame:
    """(key, ref_key, distance, keep, rank): the k nearest references of each probe no farther than `most`, equal distances by
    ref_key. Rows without three finite coordinates are no points."""
    spark, kept = probe.sparkSession, checkpoint or (lambda df, name: df.persist())
    finite = lambda df: df.where(" and ".join(f"abs({a}) < double('infinity')" for a in XYZ))
    names = [f"__k_{c}" for c in keep]
    double = [F.col(a).cast("double").alias(a) for a in XYZ]
    refs = finite(ref.select(F.col(ref_key).alias("rk"), *double, *[F.col(c).alias(n) for c, n in zip(keep, names)]))
    refs = refs.withColumn("__i", F.row_number().over(Window.partitionBy(*XYZ).orderBy("rk"))).where(F.col("__i") <= k)
    refs = kept(refs, "references")
    probes = finite(probe.select(F.col(key).alias("key"), *double))
    n = refs.where("__i = 1").count()
    leaf = max(LEAF, 2 * k) if most == float("inf") else LEAF
    every = max(1, n // (-(-n // leaf) * SAMPLE)) if n else 1
    sample = refs.where(F.col("__i") == 1).where(F.pmod(F.xxhash64(*XYZ), F.lit(every)) == 0).select(*XYZ).toPandas().to_numpy(float)
    tree = Tree(sample if len(sample) else np.zeros((1, 3)), max(1, min(leaf, leaf // every)))
    shared = spark.sparkContext.broadcast(tree)

    def placed(names: tuple[str, ...]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("leaf", pa.array(shared.value.locate(xyz(b, names)).astype(np.int64)))

        return run

    columns = ["rk", *XYZ, *names]
    ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    refs = refs.select(*columns)
    refs = kept(refs.mapInArrow(placed(XYZ), f"{ddl(refs)}, leaf long"), "leaves")
    boxes = refs.groupBy("leaf").agg(*[F.min(a) for a in XYZ], *[F.max(a) for a in XYZ]).collect()
    tree.bound({r[0]: r[1:] for r in boxes})
    bounded = spark.sparkContext.broadcast(tree)
    kinds = {f.name: f.dataType for f in refs.schema}
    schema = StructType().add("lead", "boolean")
    for c, kind in [*[(c, DoubleType()) for c in ("px", "py", "pz", "r", "distance")], *[(c, kinds[c]) for c in ("rk", *names)]]:
        schema = schema.add(c, kind)
    arrow = to_arrow_schema(schema)

    def rounds(open_: DataFrame) -> DataFrame:
        """open_: px, py, pz, r, leaf. Each leaf is sent once for each chunk of its probes."""
        counts = [(r[0], -(-r[1] // CHUNK)) for r in open_.groupBy("leaf").agg(F.count(F.lit(1))).collect()]
        chunks = F.broadcast(spark.createDataFrame(counts, "leaf long, chunks long"))
        left = open_.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("px", "py", "pz"), F.col("chunks"))).drop("chunks")
        right = refs.join(chunks, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        run = lambda a, b: meet(a, b, k, names, arrow)
        return left.groupBy("leaf", "chunk").cogroup(right.groupBy("leaf", "chunk")).applyInArrow(run, schema)

    spots = probes.select(*[F.col(a).alias(f"p{a}") for a in XYZ]).distinct().withColumn("r", F.lit(float(most)))
    spots = kept(spots.mapInArrow(placed(("px", "py", "pz")), "px double, py double, pz double, r double, leaf long"), "probes")
    own = kept(rounds(spots), "nearest")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bounded.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                p = xyz(part, ("px", "py", "pz"))
                at, leaf = t.within(p, part.column("r").to_numpy())
                other = leaf != t.locate(p)[at]
                yield part.take(pa.array(at[other])).append_column("leaf", pa.array(leaf[other].astype(np.int64)))

    visits = kept(own.where("lead").select("px", "py", "pz", "r").mapInArrow(others, "px double, py double, pz double, r double, leaf long"), "visits")
    found = own.unionByName(rounds(visits)).where("distance is not null").drop("lead", "r")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("px", "py", "pz").orderBy("distance", "rk"))).where(F.col("rank") <= k)
    out = probes.join(best, [probes[a] == best[f"p{a}"] for a in XYZ])
    return out.select(F.col("key").alias(key), F.col("rk").alias(ref_key), "distance", *[F.col(n).alias(c) for c, n in zip(keep, names)], "rank")
