"""MinHash near-duplicates by a Chosen-Path set similarity join.

A document is its set of distinct word shingles, sketched by 64 minwise values. Documents of equal sets are one from here on.
In each of several independent trees, a node's documents branch on a few coordinates that the node's path selects, others at
each depth: a child holds those that share the minwise token there. Nodes of at most `leaf` documents are compared exhaustively:
by sketches first, then, for documents with a likely partner, on full sets, and only between documents that are not connected
yet. Nodes with more go on branching, however deep.

Large groups of near copies never split. So at the second level, and every third one from there, the documents of large nodes
are first compared, in chunks, with a few of their own (hubs), and the components so far are computed. Nodes that share
documents count as one family for that. A node within one component is done. A family of a few thousand documents that aren't
in its largest component, or a node with at most `leaf` of them, has these compared with all of it, chunk by chunk; any other
node branches on. No group of copies is ever in one task, none is cut, and unlinked documents that share a passage part ways
level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.common import BROADCAST_ROWS, all_salts, bit_filter, bounded_batches, broadcast_if_small, drop_ids, in_filter, materialize, released, row_groups, salt_of, text_buffers
from larkgrid.llm.components import components
from larkgrid.llm.tokens import U64, mix64, seeds, shingles, words

SIG, TREES, BRANCH, LEAF, CHUNK, HUBS = 64, 3, 3, 256, 512, 8
#: Coordinates that a level selects from; deeper than the sketch has coordinates, what is left is compared in full.
BLOCK = 4
#: Pairs of documents of a family that are compared directly at most; below, branching would meet the same pairs more often.
EXACT = 1 << 26
#: Shingles of a group that one task compares; larger groups are cut along the shingles' hashes.
PART_SHINGLES = 1 << 22


def minwise(values: np.ndarray, before: np.ndarray, n: int = SIG, seed: int = 3) -> np.ndarray:
    """uint32 [rows, n]: per row and random order, the least value; rows without shingles have the largest number."""
    out = np.full((len(before) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(before))
    if len(full):
        add, mult = seeds(n, seed), seeds(n, seed + 1) | U64(1)
        starts = before[full]
        with np.errstate(over="ignore"):
            for j in range(n):
                out[full, j] = np.minimum.reduceat(values * mult[j] + add[j], starts) >> U64(32)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key, sig): set size, a 128-bit key of the set and minwise values; key is null for an empty set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                values, before = shingles(*words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
                sig = minwise(values, before)
                keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(before[:-1], before[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(before)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "n", "key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(released(emit), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, key binary, sig binary")


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SIG)


def _child(node: np.ndarray, coord: np.ndarray, value: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The number of a child; its last two bits are the tree's."""
    with np.errstate(over="ignore"):
        h = mix64(mix64(node + coord.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (value.astype(U64) * U64(0xFF51AFD7ED558CCD)))
    return (h & ~U64(3)) | tree


def coordinates(node: np.ndarray, tree: np.ndarray, depth: int, branches: int) -> Iterator[np.ndarray]:
    """For each branch the coordinate of each node: of its tree's and depth's block the ones that the node's number selects, all different."""
    orders = np.stack([np.argsort(mix64(seeds(SIG, 90 + t)), kind="stable") for t in range(4)])
    block = orders[:, depth * BLOCK : (depth + 1) * BLOCK]
    first = (mix64(node ^ U64(depth + 1)) % U64(BLOCK)).astype(np.int64)
    for b in range(branches):
        yield block[tree.astype(np.int64), (first + b) % BLOCK]


def branch(members: DataFrame, trees: int, branches: int, depth: int) -> DataFrame:
    """(node, rep) of the next level. members: node, rep, sig; at depth 0 without node, each is in the root of each tree (4 at most)."""
    kind = dict(members.dtypes)["rep"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sig(batch.column(1))
            rows = np.arange(len(sig))
            for t in range(1 if depth else trees):
                node = batch.column(2).to_numpy(zero_copy_only=False).view(U64) if depth else np.full(len(sig), U64(t))
                tree = node & U64(3)
                for coord in coordinates(node, tree, depth, branches):
                    yield pa.RecordBatch.from_arrays([pa.array(_child(node, coord, sig[rows, coord], tree).view(np.int64)), batch.column(0)], ["node", "rep"])

    return members.select("rep", "sig", *(["node"] if depth else [])).mapInArrow(released(emit), f"node long, rep {kind}")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal values of the first column (long) of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def likely(sig: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i of side 0, i < j among side 0, whose sketches and sizes allow the similarity. A pair of just that similarity
    is missed with a probability of less than one in a million."""
    p = percent / 100
    least = int(SIG * p - 5.5 * sqrt(SIG * p * (1 - p)))
    own = np.flatnonzero(side == 0)
    found_i, found_j = [], []
    for i in own:
        same = np.count_nonzero(sig == sig[i], axis=1)
        near = (same >= least) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((side == 1) | (np.arange(len(n)) > i))
        near[i] = False
        js = np.flatnonzero(near)
        found_i.append(np.full(len(js), i))
        found_j.append(js)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def candidates(groups: DataFrame, reps: DataFrame, percent: int, comps: DataFrame | None = None) -> DataFrame:
    """(gid, rep, side, c): from groups (gid, rep, side), the parts that likely pairs of different components connect; equal parts of
    several groups are one. comps (v, c) are the components so far; without them each document is its own."""
    kind = dict(groups.dtypes)["rep"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches):
            if group.num_rows > 1:
                n, side = (group.column(c).to_numpy() for c in ("n", "side"))
                rep, comp = group.column("rep").to_pylist(), pd.factorize(group.column("c").to_pandas())[0]
                if comp.max() == 0:
                    continue
                i, j = likely(_sig(group.column("sig")), n, side, percent)
                apart = comp[i] != comp[j]
                i, j = i[apart], j[apart]
                parent = np.arange(len(n))
                for a, b in zip(i.tolist(), j.tolist()):
                    parent[find(parent, a)] = find(parent, b)
                if len(i):
                    parts: dict[int, list[int]] = {}
                    label = group.column("c").to_pylist()
                    for x in sorted({*i.tolist(), *j.tolist()}):
                        parts.setdefault(find(parent, x), []).append(x)
                    for part in parts.values():
                        own = sorted((rep[x], int(side[x]), label[x]) for x in part)
                        gid = xxhash.xxh3_64_intdigest(repr(own).encode()) - (1 << 63)
                        out.extend((gid, r, s, c) for r, s, c in own)
            if len(out) > 20_000:
                yield _rows(out, kind)
                out = []
        if out:
            yield _rows(out, kind)

    def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
        g, r, s, c = zip(*rows)
        own = lambda v: pa.array(v).cast(pa.int64() if kind == "bigint" else pa.array(v).type)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), own(r), pa.array(s, pa.int32()), own(c)], ["gid", "rep", "side", "c"])

    known = reps.select("rep", "n", "sig", F.col("rep").alias("c"))
    if comps is not None:
        known = reps.select("rep", "n", "sig").join(comps.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    sent = groups.join(known, "rep").select("gid", "rep", "side", "n", "sig", "c")
    return sent.repartition("gid").sortWithinPartitions("gid", "rep").mapInArrow(released(emit), f"gid long, rep {kind}, side int, c {kind}").distinct()


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of sorted distinct values."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def shared_counts(sets: list[np.ndarray], which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `which`: the sizes of its intersections with all sets (none of them empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    ids = pd.factorize(flat)[0]
    mark = np.zeros(len(flat), np.int32)
    for a in which.tolist():
        own = ids[starts[a] : starts[a] + len(sets[a])]
        mark[own] = 1
        yield a, np.add.reduceat(mark[ids], starts)
        mark[own] = 0


def verify(parts: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, most: int = PART_SHINGLES) -> DataFrame:
    """Edges (a, b) that connect, within each part (gid, rep, side, c), what links on full sets connect beside the components c."""
    kind = dict(parts.dtypes)["rep"]
    parts = materialize(parts, "parts", narrow=True)
    needed = materialize(reps.join(parts.select("rep").distinct(), "rep").select("rep", "key", "sig", "n"), "needed")
    # whole texts stay where they are: a bit filter, 16 bits a set up to 32 MB, picks those whose sets are needed
    bits = 1 << min(28, max(16, (16 * needed.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(needed.select(F.xxhash64("rep").alias("h")), "h", bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(in_filter(shared.value, batch.column(2).to_numpy().view(U64))))
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                values, before = shingles(*words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
                ends = list(zip(before[:-1], before[1:]))
                keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in ends]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(keys, pa.binary()), pa.array([values[a:b].tobytes() for a, b in ends], pa.binary())], ["rep", "key", "values"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", F.xxhash64("doc_id").alias("h"))
    # rows of equal doc_id: the one that the representative stands for
    full = texts.mapInArrow(released(sets), f"rep {kind}, key binary, values binary").join(needed.withColumnRenamed("key", "own"), "rep").where("key = own")
    full = full.groupBy("rep").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("values").alias("values"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            n, side, gid = (group.column(c).to_numpy() for c in ("n", "side", "gid"))
            rep, raw = group.column("rep").to_pylist(), group.column("values")
            i, j = likely(_sig(group.column("sig")), n, side, percent)
            comp = pd.factorize(group.column("c").to_pandas())[0]
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
            parent = np.unique(comp, return_index=True)[1][comp]  # documents of a component are connected
            cache: dict[int, np.ndarray] = {}

            def values(x: int) -> np.ndarray:
                if x not in cache:
                    cache[x] = np.frombuffer(raw[x].as_py(), U64)
                return cache[x]

            if len(i) > 4 * len(n):  # many likely pairs: each document against all at once
                for a, common in shared_counts([values(x) for x in range(len(n))], np.unique(i)):
                    for b in np.flatnonzero((100 * common >= percent * (n[a] + n - common)) & (comp != comp[a])).tolist():
                        ra, rb = find(parent, a), find(parent, b)
                        parent[ra] = rb
            else:
                for a, b in zip(i.tolist(), j.tolist()):
                    ra, rb = find(parent, a), find(parent, b)
                    if ra != rb and jaccard_at_least(values(a), values(b), percent):
                        parent[ra] = rb
            roots = np.array([find(parent, x) for x in range(len(n))])
            order = mix64(np.arange(len(n), dtype=U64) ^ gid.view(U64))  # the centre of each star differs from group to group
            centre: dict[int, int] = {}
            edges, met = [], set()
            for x in np.argsort(order).tolist():
                root = int(roots[x])
                if root not in centre:
                    centre[root] = x
                elif int(comp[x]) not in met and comp[x] != comp[centre[root]]:  # one edge connects a component
                    edges.append((rep[centre[root]], rep[x]))
                met.add(int(comp[x]))
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, group.column("rep").type), pa.array(b, group.column("rep").type)], ["a", "b"])

    sent = parts.join(full, "rep").select("gid", "rep", "side", "n", "sig", "c", "values")
    sizes = parts.join(needed.select("rep", "n"), "rep").groupBy("gid").agg(F.sum("n").alias("size")).where(F.col("size") > most)
    heavy = materialize(sizes.select("gid", F.ceil(F.col("size") / most).cast("int").alias("slices")), "heavy", narrow=True)
    if heavy.isEmpty():
        found = sent.repartition("gid").sortWithinPartitions("gid", "rep").mapInArrow(released(link), f"a {kind}, b {kind}")
    else:
        sent = materialize(sent, "sets")
        light = sent.join(broadcast_if_small(heavy, BROADCAST_ROWS), "gid", "left_anti")
        found = light.repartition("gid").sortWithinPartitions("gid", "rep").mapInArrow(released(link), f"a {kind}, b {kind}")
        found = found.union(linked_by_slices(sent.join(broadcast_if_small(heavy, BROADCAST_ROWS), "gid"), kind, percent))
    links = materialize(found.distinct(), "links", narrow=True)
    shared.destroy()  # up to 32 MB, which would stay on the driver for each call
    return links


def linked_by_slices(sent: DataFrame, kind: str, percent: int) -> DataFrame:
    """Edges (a, b) of all links in groups whose sets are too large for one task: each slice of the hashes' range counts what likely
    pairs share there, and the counts are summed. sent: gid, rep, side, n, sig, c, values, slices."""
    names = ["slice", "gid", "rep", "side", "n", "sig", "values"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                gid, values, slices = batch.column(0)[r].as_py(), np.frombuffer(batch.column(6)[r].as_py(), U64), batch.column(7)[r].as_py()
                bounds = [0, *np.searchsorted(values, np.array([(i << 64) // slices for i in range(1, slices)], U64)).tolist(), len(values)]
                keys = pa.array([xxhash.xxh3_64_intdigest(f"{gid},{i}".encode()) - (1 << 63) for i in range(slices)])
                same = pa.array(np.zeros(slices, np.int64))
                pieces = pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, *[batch.column(c).slice(r, 1).take(same) for c in range(5)], pieces], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            n, side = group.column("n").to_numpy(), group.column("side").to_numpy()
            i, j = likely(_sig(group.column("sig")), n, side, percent)
            sets = [np.frombuffer(x.as_py(), U64) for x in group.column("values")]
            filled = np.flatnonzero([len(x) > 0 for x in sets])
            place = np.full(len(sets), -1)
            place[filled] = np.arange(len(filled))
            common = np.zeros(len(i), np.int64)
            mine = np.unique(i[place[i] >= 0])
            for a, shared in shared_counts([sets[x] for x in filled], place[mine]) if len(mine) else ():
                at = np.flatnonzero(i == filled[a])
                at = at[place[j[at]] >= 0]
                common[at] = shared[place[j[at]]]
            rep = group.column("rep").combine_chunks()
            gid = group.column("gid").combine_chunks().take(pa.array(i))
            yield pa.RecordBatch.from_arrays([gid, rep.take(pa.array(i)), rep.take(pa.array(j)), pa.array(common), pa.array(n[i] + n[j])], ["gid", "a", "b", "common", "both"])

    sliced = sent.select("gid", "rep", "side", "n", "sig", "c", "values", "slices").mapInArrow(released(cut), f"slice long, gid long, rep {kind}, side int, n long, sig binary, values binary")
    counted = sliced.repartition("slice").sortWithinPartitions("slice", "rep").mapInArrow(released(count), f"gid long, a {kind}, b {kind}, common long, both long")
    total = counted.groupBy("gid", "a", "b").agg(F.sum("common").alias("common"), F.max("both").alias("both"))
    return total.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")




def find_edges(docs: DataFrame, reps: DataFrame, k: int, percent: int, trees: int = TREES, branches: int = BRANCH, leaf: int = LEAF, chunk: int = CHUNK, exact: int = EXACT, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Edges (a, b) between representatives whose components are those of all links.

    A link of similarity p stays together in a child with probability p. With three branches at the root and two below, at any
    depth, one tree parts it from all its common leaves with a probability of 0.6 % at 0.85 (1.7 % at 0.8), three trees with
    less than one in 200 000.
    """
    nodes, groups, edges, comps = branch(reps, trees, branches, 0), [], None, None
    for depth in range(SIG // BLOCK):
        nodes = materialize(nodes, "nodes", narrow=True)
        # narrow rows; where a node holds a large share of them, adaptive execution splits the join
        nodes = materialize(nodes.join(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "node"), "nodes", narrow=True)
        groups.append(nodes.where(F.col("m") <= leaf).select(F.col("node").alias("gid"), "rep", F.lit(0).alias("side")))
        large = nodes.where(F.col("m") > leaf)
        last = depth == SIG // BLOCK - 1
        if large.isEmpty():
            break
        if depth % 3 == 1:
            of_node, members = families(large.select("node", "rep"))
            more = hub_edges(members, docs, reps, k, percent, chunk, part_shingles, comps)
            edges = more if edges is None else materialize(edges.union(more).distinct(), "links", narrow=True)
            comps = components(edges)
            ready, rest = outside(members, comps, chunk, F.col("o") * F.col("m") <= exact)
            groups.append(ready)
            on = of_node.join(rest.select(F.col("node").alias("c")).distinct(), "c").select(F.col("v").alias("node"))
            large = materialize(large.join(on, "node"), "nodes", narrow=True)
            if large.isEmpty():
                break
        if comps is not None:
            ready, large = outside(large, comps, chunk, F.lit(True) if last else F.col("o") <= leaf)
            groups.append(ready)
            if last or large.isEmpty():
                break
        nodes = branch(large.select("node", "rep").join(reps.select("rep", "sig"), "rep"), trees, 2, depth + 1)
    together = groups[0]
    for g in groups[1:]:
        together = together.unionByName(g)
    found = verify(candidates(together, reps, percent, comps), docs, reps, k, percent, part_shingles)
    return found if edges is None else edges.union(found)


def on_node(members: DataFrame, facts: DataFrame, label: str) -> DataFrame:
    """members (node, rep, ...) with the facts of their nodes, one row a node: broadcast if counted to be few, else with salt."""
    facts = materialize(facts, label, narrow=True)
    if facts.count() <= BROADCAST_ROWS:
        return members.join(F.broadcast(facts), "node")
    return members.withColumn("salt", salt_of("rep")).join(facts.select("*", all_salts("salt")), ["node", "salt"]).drop("salt")


def families(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The family c of each node v, and the families' members (node, rep, m). Nodes of near copies hold much the same documents, once
    for each tree and coordinate; nodes that share a document are of one family."""
    first = large.groupBy("rep").agg(F.min("node").alias("b"))
    of_node = components(large.join(first, "rep").select(F.col("node").alias("a"), "b").distinct())
    members = materialize(on_node(large, of_node.select(F.col("v").alias("node"), "c"), "names").select(F.col("c").alias("node"), "rep").distinct(), "members", narrow=True)
    return of_node, materialize(on_node(members, members.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "sizes"), "families", narrow=True)


def hub_edges(members: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, chunk: int, part_shingles: int, comps: DataFrame | None) -> DataFrame:
    """Links of the documents of families (node, rep, m) with a few hubs of their own."""
    chunks = F.ceil(F.col("m") / chunk)
    hubs = members.groupBy("node", F.pmod(F.xxhash64("rep", "node"), F.lit(HUBS)).alias("cell")).agg(F.min(F.struct(F.xxhash64("node", "rep"), "rep")).alias("h"), F.max("m").alias("m"))
    hubs = hubs.select("node", F.col("h.rep").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(0).alias("side"))
    rest = members.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks)).select("node", "rep", "chunk", F.lit(1).alias("side"))
    around = hubs.unionByName(rest).groupBy(F.xxhash64("node", "chunk").alias("gid"), "rep").agg(F.min("side").alias("side"))
    return verify(candidates(around, reps, percent, comps), docs, reps, k, percent, part_shingles)


def outside(large: DataFrame, comps: DataFrame, chunk: int, ready: Column) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, rep, m) with members of several components: groups (gid, rep, side) that compare those outside the largest
    component with all, in nodes that are ready (by m and o, the number outside); and the other nodes."""
    labelled = materialize(large.join(comps.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")), "labelled", narrow=True)
    by_comp = labelled.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n"))
    state = by_comp.groupBy("node").agg(F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("node", F.col("top.n").alias("top_n"), F.col("top.c").alias("top_c"))
    open_ = on_node(labelled, state, "states")
    chunks = F.ceil(F.col("m") / chunk)
    split = materialize(open_.withColumns({"o": F.col("m") - F.col("top_n"), "all": chunks, "at": F.pmod(F.xxhash64("rep"), chunks)}), "split", narrow=True)
    done = split.where(ready)
    # chunk i's documents outside with chunk j's, but those outside of j only where i <= j: no pair twice
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    own = done.where("c <> top_c").select("node", "rep", F.col("at").alias("i"), upto(F.col("all") - 1).alias("j"), F.lit(0).alias("side"))
    every = done.select("node", "rep", upto(F.when(F.col("c") == F.col("top_c"), F.col("all") - 1).otherwise(F.col("at"))).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"))
    groups = own.unionByName(every).groupBy(F.xxhash64("node", "i", "j").alias("gid"), "rep").agg(F.min("side").alias("side"))
    return groups, split.where(~ready).select("node", "rep", "m")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    Documents are linked whose shingle sets have 100 * intersection >= percent * union. Words are what ASCII white space
    separates, A-Z lower-cased. A text of fewer than k words is one shingle; without words, or null, it has none and is linked
    with nothing. component_id is the smallest doc_id reachable; kept marks it. Rows of equal doc_id are one vertex. Rows
    without doc_id are linked with nothing, have a null component_id and are kept. Empty tables give an empty table. Texts are
    worked on whole; columns but doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sk = materialize(sketches(docs, k), "sketches")
    same = sk.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("s"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(same.select("key", F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"), F.col("s.sig").alias("sig"), "copies"), "representatives")
    edges = find_edges(docs, reps, k, percent, **options)
    # rows of one doc_id with different texts are one vertex
    comps = components(edges)
    by_key = materialize(reps.join(comps, reps.rep == comps.v, "left").where("copies > 1 or c is not null").select("key", F.coalesce("c", "rep").alias("c")), "classes", narrow=True)
    if by_key.count() <= BROADCAST_ROWS:
        found = sk.select("doc_id", "n", "key").join(F.broadcast(by_key), "key", "left")
    else:
        found = sk.select("doc_id", "n", "key", salt_of("doc_id").alias("salt")).join(by_key.select("*", all_salts("salt")), ["key", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but those whose component has a smaller doc_id; of equal rows all stay."""
    return drop_ids(docs, near_duplicates(docs, k, percent).where("not kept"), "doc_id")
