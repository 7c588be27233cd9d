"""Centroid clustering: Lloyd's rounds over whole-number vectors, each as a walk down two cover trees.

Vectors lie in blocks of up to BLOCK rows, in the order they are read, so equal or near vectors never meet in one task for being
equal. A block's distinct vectors form a cover tree, built once: farthest-first order gives nested nets at every power of two
(covering and separation hold by construction), a vector's parent is the nearest member of the next coarser net, and a subtree is a
stretch of the block. Each round builds the same tree over the centroids (at most a parameter's worth) and walks both: a pair of
nodes goes if its least possible distance is above the largest possible distance to the nearest centroid; a vector node that is left with one
centroid takes it whole; single vectors compare the centroids that are left exactly, in whole numbers. Bounds give way by a margin
above the rounding of square roots, so ties always reach that comparison. What leaves a block in a round is a sum and a count
a centroid; the driver sees only their totals.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; components of more than
2**20 in size count as 2**20 (so that squared distances fit a long); rows that repeat an id or a vector count each; null ids come last
among the seeds; fewer vectors than centroids give as many centroids as there are; equal centroids leave all to the smaller number; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, materialise

BLOCK = 1024
SIZE = 1 << 26  # largest component, after scaling
EXACT = 1 << 22  # products of components below this are exact in doubles
TREE = "order binary, centre binary, lo binary, hi binary, radius binary, kids binary, first binary"
BLOCKS = f"ids array<bigint>, owner binary, points binary, {TREE}"


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every other, exact."""
    if max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)) < EXACT:
        a, b = points.astype(float), others.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((points - o) ** 2).sum(1) for o in others], axis=1)


class CoverTree:
    """A node is a centre, a stretch [lo, hi) of order, a radius and its children kids[first[i]:first[i + 1]]; node 0 is the root."""

    def __init__(self, points: np.ndarray) -> None:
        """points: distinct rows of whole numbers."""
        apart = np.sqrt(squares(points, points).astype(float))
        n = len(points)
        chosen, level, parent = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
        near = apart[0].copy()
        for i in range(1, n):
            chosen[i] = far = int(near.argmax())
            level[i] = int(np.ceil(np.log2(near[far]))) - 1
            coarser = chosen[: 1 + int(np.searchsorted(-level[1:i], -level[i]))]  # members of the next coarser net come first
            parent[far] = coarser[apart[far, coarser].argmin()]
            np.minimum(near, apart[far], out=near)
        below: list[dict[int, list[int]]] = [{} for _ in range(n)]
        for i in range(1, n):
            below[parent[chosen[i]]].setdefault(int(level[i]), []).append(int(chosen[i]))
        self.order: np.ndarray = np.zeros(n, np.int32)
        self.used, nodes, kids = 0, [], []

        def grow(p: int, levels: list[int]) -> int:
            me, lo = len(nodes), self.used
            nodes.append(None)
            kids.append([])
            if levels:
                kids[me] = [grow(p, levels[1:]), *[grow(c, list(below[c])) for c in below[p][levels[0]]]]
            else:
                self.order[self.used] = p
                self.used += 1
            nodes[me] = (p, lo, self.used, apart[p, self.order[lo : self.used]].max() * (1 + 1e-9))
            return me

        grow(0, list(below[0]))
        self.centre, self.lo, self.hi = (np.array([x[i] for x in nodes], np.int32) for i in range(3))
        self.radius = np.array([x[3] for x in nodes])
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in kids])]).astype(np.int32)
        self.kids = np.array([c for k in kids for c in k], np.int32)

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in ("order", "centre", "lo", "hi", "radius", "kids", "first")}

    @classmethod
    def read(cls, row: dict) -> CoverTree:
        tree = cls.__new__(cls)
        for name in ("order", "centre", "lo", "hi", "kids", "first"):
            setattr(tree, name, np.frombuffer(row[name], np.int32))
        tree.radius = np.frombuffer(row["radius"])
        return tree


def nearest(tree: CoverTree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point (ties: the smaller number), and how many pairs were compared exactly as leaves."""
    own, number = np.unique(centroids, axis=0, return_index=True)
    by = np.argsort(number)
    own, number = own[by], number[by]  # distinct centroids in order of number
    over = CoverTree(own)
    child = np.zeros((len(over.centre), len(over.centre)), np.int32)
    for i in range(len(over.centre)):
        child[i, over.kids[over.first[i] : over.first[i + 1]]] = 1
    is_leaf = over.hi - over.lo == 1
    is_leaf &= ~child.any(1)
    found, compared = np.full(len(points), -1), 0
    exact = np.full((len(points), len(own)), -1, np.int64)  # squared distances, as far as they are asked for
    nodes, live = np.zeros(1, np.int32), np.zeros((1, len(over.centre)), bool)
    live[0, 0] = True
    while len(nodes):
        centre, radius = tree.centre[nodes], tree.radius[nodes]
        new = np.unique(centre[exact[centre, 0] < 0])
        if len(new):
            exact[new] = squares(points[new], own)
        off = np.sqrt(exact[centre].astype(float))[:, over.centre]
        most = np.where(live, off, np.inf).min(1) + radius
        live &= off - radius[:, None] - over.radius <= (most * (1 + 1e-9) + 1e-9)[:, None]
        alone = (live.sum(1) == 1) & (live & is_leaf).any(1)
        single = (tree.hi[nodes] - tree.lo[nodes] == 1) & ~(live & ~is_leaf).any(1) & ~alone
        for at in np.flatnonzero(alone):
            found[tree.order[tree.lo[nodes[at]] : tree.hi[nodes[at]]]] = over.centre[live[at].argmax()]
        if single.any():
            allowed = np.zeros((int(single.sum()), len(own)), bool)
            row, node = np.nonzero(live[single])
            allowed[row, over.centre[node]] = True
            compared += len(row)
            found[centre[single]] = np.where(allowed, exact[centre[single]], np.iinfo(np.int64).max).argmin(1)
        going = ~(alone | single)
        nodes, live, radius = nodes[going], live[going], radius[going]
        wide = live & ~is_leaf & ((over.radius > radius[:, None]) | (tree.hi[nodes] - tree.lo[nodes] == 1)[:, None])
        split = wide.any(1)
        narrowed = (live[split] & ~wide[split]) | (wide[split].astype(np.int32) @ child > 0)
        counts = tree.first[nodes[~split] + 1] - tree.first[nodes[~split]]
        kids = np.concatenate([np.zeros(0, np.int32), *[tree.kids[tree.first[i] : tree.first[i + 1]] for i in nodes[~split]]])
        nodes, live = np.concatenate([nodes[split], kids]), np.concatenate([narrowed, np.repeat(live[~split], counts, axis=0)])
    return number[found], compared


def _plant(size: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with the cover tree of their distinct vectors."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points = table.column("q").combine_chunks().flatten().to_numpy().reshape(-1, width)
        own, owner = np.unique(points, axis=0, return_inverse=True)
        row = {"ids": table.column("id").to_pylist(), "owner": owner.astype(np.int32).tobytes(), "points": own.astype(np.int32).tobytes(), **CoverTree(own).packed()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("ids", pa.list_(pa.int64())), *[(name, pa.binary()) for name in list(row)[1:]]]))

    for batch in batches:
        while batch.num_rows:
            room = size - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == size:
                yield block()
                held.clear()
    if held:
        yield block()


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, np.frombuffer(row["points"], np.int32).reshape(-1, width).astype(np.int64), np.frombuffer(row["owner"], np.int32)


def _totals(centroids: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts and componentwise sums of what each centroid takes."""
    at = np.array(centroids, np.int64)
    sums, counts = np.zeros(at.shape, np.int64), np.zeros(len(at), np.int64)
    for row, points, owner in _read(batches, at.shape[1]):
        own, weight = nearest(CoverTree.read(row), points, at)[0], np.bincount(owner, minlength=len(points))
        np.add.at(counts, own, weight)
        np.add.at(sums, own, points * weight[:, None])
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": counts[used], "sums": pa.array(list(sums[used]), pa.list_(pa.int64()))})


def _assigned(centroids: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = np.array(centroids, np.int64)
    for row, points, owner in _read(batches, at.shape[1]):
        own = nearest(CoverTree.read(row), points, at)[0]
        off = ((points - at[own]) ** 2).sum(1)
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(own[owner], pa.int32()), "distance": off[owner]})


def whole_vectors(vectors: DataFrame, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, q (array<bigint>): floor(scale * x) of the vectors that are whole."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.where((F.size("x") == width) & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    return rows.select("id", F.transform("x", lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(float(-SIZE))), F.lit(float(SIZE)))).cast("long")).alias("q"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after rounds of Lloyd, and the final centroids. k bounds what the driver and every task hold of the centroids."""
    rows = whole_vectors(vectors, width, scale, id_col, vector_col)
    mark = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    centroids = [list(r.q) for r in rows.orderBy(mark.asc_nulls_last(), "q").limit(k).collect()]
    if not centroids:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    blocks = materialise(rows.mapInArrow(partial(_plant, BLOCK, width), BLOCKS), "cover-trees")
    for _ in range(rounds):
        taken = blocks.mapInArrow(partial(_totals, centroids), "cluster int, n long, sums array<bigint>").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for r in taken.collect():
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    out = materialise(blocks.mapInArrow(partial(_assigned, centroids), "vec_id long, cluster int, distance long"), "clusters")
    forget(blocks.sparkSession, blocks)
    return out, centroids


def clusters(vectors: DataFrame, **more) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. A sum that no long holds is null."""
    rows, centroids = cluster(vectors, **more)
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    fits = lambda n: n if n < 2**63 else None
    named = [(i, fits(sums.get(i, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    report = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
