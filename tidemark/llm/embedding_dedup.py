"""Near-duplicate vectors with a forest of random-projection trees.

Equal vectors are one entry with a weight (told apart by 96 bits of hash). Each
tree splits space by random directions; a split is put where few vectors are
near, within the middle half, so that clusters stay whole, and vectors near it go
to both sides. Trees are fitted on a bounded sample (``SAMPLE`` entries) and end
where it runs out, so leaves grow with the number of vectors beyond it. All
vectors are then routed to leaves, all pairs within a leaf are compared in double
precision, and the links of all trees are united.

A vector travels once to each branch (a node of some ``BRANCH`` leaves) of each
tree that it reaches; the task that holds a branch routes it on to the leaves,
since the forest is known everywhere. A branch of more than ``2 * BRANCH * leaf``
vectors, counted before anything is sent, is dealt in blocks: each pair of blocks
is a group of its own, so no task holds the whole, and no vector is left out.

Pairs never leave the task that finds them. A pair belongs to the first leaf of
the forest that both vectors reach; there it is counted for both ends, and
joined into a tree of at most one edge per vector. So what a group of near copies
gives is linear in its size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; rows equal
in id or vector are each a vector; a null id takes part but is no component's id
unless all are null; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, cut

SAMPLE = 20_000
TREES = 3
LEAF = 1000
BRANCH = 16


class Tree:
    """Splits fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, margin: float, seed: int):
        self.seed, self.margin, self.dim = seed, margin, sample.shape[1]
        self.nodes: list[tuple] = []
        #: nodes where a branch begins
        self.branches: set[int] = set()
        self._grow(sample, total / max(len(sample), 1), leaf, False)

    def _direction(self, node: int) -> np.ndarray:
        d = np.random.default_rng([self.seed, node]).standard_normal(self.dim)
        return d / np.linalg.norm(d)

    def _grow(self, sample: np.ndarray, scale: float, leaf: int, inside: bool) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        size = len(sample) * scale
        d = self._direction(me)
        p = sample @ d
        end = size <= leaf or len(sample) < 8
        if not end:
            q = np.sort(p)
            places = np.linspace(q[len(q) // 4], q[-len(q) // 4], 33)
            near = np.searchsorted(q, places + self.margin) - np.searchsorted(q, places - self.margin)
            at = float(places[near.argmin()])
            side = p > at
            end = side.all() or not side.any()  # nothing to split by: all alike
        if not inside and (end or size <= BRANCH * leaf):
            self.branches.add(me)
            inside = True
        if end:
            self.nodes[me] = (None,)
        else:
            self.nodes[me] = (d, at, self._grow(sample[~side], scale, leaf, inside), self._grow(sample[side], scale, leaf, inside))
        return me

    def reached(self, x: np.ndarray, branches: bool = False) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, node) for all leaves, or branches, that vectors reach."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            n = self.nodes[node]
            if node in self.branches if branches else n[0] is None:
                yield rows, node
                continue
            p = x[rows] @ n[0]
            todo += [(n[2], rows[p <= n[1] + self.margin]), (n[3], rows[p > n[1] - self.margin])]


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _links(x: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, earlier: list[tuple[np.ndarray, np.ndarray]], threshold: float, slab: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each vector's links, smallest row that it is joined with) over the pairs of each group (first, second) that no group before it, and none of `earlier`, has.

    A group's two sides are the same rows, or have none in common. `earlier`: rows of leaves that come before.
    """
    others, root = np.zeros(len(x), np.int64), np.arange(len(x))
    seen: list[tuple[np.ndarray, int]] = [(rows, n) for n, (rows, _) in enumerate(earlier)]
    for first, second in groups:
        for k in range(0, len(first), slab):
            some = first[k : k + slab]
            p, q = np.nonzero(x[some] @ x[second].T >= threshold)
            p, q = some[p], second[q]
            if first is second:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            if seen:
                rows = np.unique(np.concatenate([p, q]))
                place = np.full(len(x), -1)
                place[rows] = np.arange(len(rows))
                before = np.zeros((len(rows), len(seen)), np.float32)
                for held, n in seen:
                    at = place[held]
                    before[at[at >= 0], n] = 1.0
                before = before[:, before.sum(0) > 1]
                alone = np.ones(len(p), bool)
                for c in range(0, len(p), 200_000):
                    part = slice(c, c + 200_000)
                    alone[part] = np.einsum("ij,ij->i", before[place[p[part]]], before[place[q[part]]]) == 0
                p, q = p[alone], q[alone]
            others += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
            while (root[p] != root[q]).any():
                low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
        seen.append((np.union1d(first, second), len(seen)))
    return others, root


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    hashed = all_rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")))
    good, bad = hashed.where(fine), all_rows.where(~fine)
    entries = good.groupBy("h").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("v").alias("v"))
    entries = cut(entries.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    dims = {r.dim: r.n for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    forest: dict[int, list[Tree]] = {}
    for d, n in dims.items():
        some = _unit(np.array([r.v for r in entries.where(F.col("dim") == d).orderBy(F.xxhash64("first", "c")).limit(sample).select("v").collect()], np.float64))
        margin = 0.8 * math.sqrt(max(2 - 2 * threshold, 1e-6) / d)
        forest[d] = [Tree(some, n, leaf, margin, seed + t) for t in range(trees)]
    sent = spark.sparkContext.broadcast(forest)
    size = BRANCH * leaf

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dimension, rows of the batch, their unit vectors)."""
        of = batch.column("dim").to_numpy()
        for d in np.unique(of).tolist():
            at = np.flatnonzero(of == d)
            yield d, at, _unit(_matrix(batch.column("v").take(pa.array(at))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for d, _, x in parts(batch):
                for t, tree in enumerate(sent.value[d]):
                    for got, node in tree.reached(x, branches=True):
                        found[d, t, node] = found.get((d, t, node), 0) + len(got)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([found[k] for k in keys], pa.int64())], names=["dim", "tree", "branch", "n"])

    sizes = entries.select("dim", "v").mapInArrow(count, "dim int, tree int, branch int, n long").groupBy("dim", "tree", "branch").agg(F.sum("n").alias("n"))
    # a row for each branch, of which the sample allows so many
    blocks = spark.sparkContext.broadcast({(r.dim, r.tree, r.branch): 1 if r.n <= 2 * size else -(-r.n // size) for r in sizes.collect()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").to_numpy()
            for d, at, x in parts(batch):
                for t, tree in enumerate(sent.value[d]):
                    for got, node in tree.reached(x, branches=True):
                        many = blocks.value[d, t, node]
                        take = np.repeat(at[got], many)
                        own = ((c[take].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(many)).astype(np.int32)
                        other = np.tile(np.arange(many, dtype=np.int32), len(got))
                        same = [pa.array(np.full(len(take), k, np.int32)) for k in (d, t, node)]
                        carried = [batch.column(k).take(pa.array(take)) for k in ("c", "weight", "v")]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own), *carried], names=["dim", "tree", "branch", "i", "j", "own", "c", "weight", "v"])

    kind = dict(entries.dtypes)["v"]
    routed = entries.select("dim", "c", "weight", "v").mapInArrow(route, f"dim int, tree int, branch int, i int, j int, own int, c long, weight long, v {kind}")

    def compare(table: pa.Table) -> pa.Table:
        d, t, i, j = (table.column(k)[0].as_py() for k in ("dim", "tree", "i", "j"))
        c, weight, own = (table.column(k).to_numpy() for k in ("c", "weight", "own"))
        x = _unit(_matrix(table.column("v").combine_chunks()))
        branch = table.column("branch")[0].as_py()
        forest = sent.value[d]
        earlier = [got for k in range(t) for got in forest[k].reached(x)]
        groups = []
        for got, node in sorted(forest[t].reached(x), key=lambda g: g[1]):
            if i == j:
                sides = (got, got)
            else:
                sides = (got[own[got] == i], got[own[got] == j])
            if branch <= node < _end(forest[t], branch):
                groups.append(sides)
            elif node < branch:
                earlier.append((got, node))
        others, root = _links(x, groups, weight, earlier, threshold)
        found = others > 0
        return pa.table({"c": c[found], "others": others[found], "root": c[root[found]]})

    found = cut(routed.groupBy("dim", "tree", "branch", "i", "j").applyInArrow(compare, "c long, others long, root long"))
    near = found.groupBy("c").agg(F.sum("others").alias("others"))
    joined = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    of = (
        entries.select("h", "first", "weight", "c").join(near, "c", "left").join(joined.withColumnRenamed("node", "c"), "c", "left")
        .select("h", "first", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component"))
    )
    low = of.groupBy("component").agg(F.min("first").alias("component_id"))
    told = of.join(low, "component").select("h", "n_links", "component_id")
    out = good.select("vec_id", "h").join(told, "h").select("vec_id", "n_links", "component_id")
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _end(tree: Tree, node: int) -> int:
    """One past the last node below this one; nodes are numbered in preorder."""
    while tree.nodes[node][0] is not None:
        node = tree.nodes[node][3]
    return node + 1
