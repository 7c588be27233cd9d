"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Distinct vectors are nodes (equal ones count as a weight and link at once). A table has its own random hyperplanes; a node's
cell there is the string of its signs. Bits grow with the logarithm of the nodes, so that a cell of unrelated vectors stays near CELL rows,
and tables with the bits, so that a pair at the threshold is in no common cell with a chance of MISS at most (more similar pairs much less).
A cell is compared exactly, in double precision, inside one task, tile by tile; what leaves it is a number of links a
node and a spanning forest of its links, never the pairs. A pair that meets in several cells counts in the first of its tables only.

Groups of near copies: a crowded cell of the first table gives a pivot, the mean direction of its nodes; nodes of that cell and of those one
bit away that lie within half the threshold's angle of the pivot are its core (the most crowded of several). All of a core link with one another,
by the triangle inequality of angles, so they are counted without a comparison. A crowded cell of any table is cut into blocks of up
to LIMIT rows, each core into its own; blocks of one core don't meet.

Defined cases: null vectors, those without components, of zero length, or with null or non-finite components link with nothing, and each is its own
component; vectors of different lengths don't link; rows that repeat an id or a vector take part each by itself; null ids order last,
and a component of such rows only has a null component_id and keeps them all; an empty table gives an empty result; other columns
are ignored. Nodes are named by 64-bit hashes: among n of them two share a name with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import math
from functools import partial
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, materialise, meet
from siltstone.llm.components import components
from siltstone.llm.repeats import LAST

CELL = 1024
LIMIT = 4096  # rows a task compares with as many; of a crowded cell, a block
MISS = 1e-4
TASK_BYTES = 32 << 20  # of vectors on either side of a comparison, which bounds LIMIT where vectors are long
TILE = 512
SLACK = 1e-9  # radians by which cores are smaller than they could be
FOUND = "node long, links long, other long"


def tables(nodes: int, cosine: float, cell: int = CELL, miss: float = MISS) -> tuple[int, int]:
    """Bits of a cell and number of tables for that many nodes."""
    bits = min(24, max(1, math.ceil(math.log2(max(nodes, 2) / cell))))
    same = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def planes(width: int, bits: int, n: int) -> np.ndarray:
    return np.random.default_rng(13).standard_normal((width, n * bits)) if width else np.zeros((0, n * bits))


def _matrix(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(-1, width)


def _sign(bits: int, n: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the unit vector and its cells in all tables (32 bits each)."""
    for frame in frames:
        for width, own in frame.groupby("width"):
            x = np.stack([np.asarray(v, float) for v in own["x"]])
            x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            up = (x @ planes(int(width), bits, n) > 0).reshape(len(x), n, bits)
            cells = (up << np.arange(bits)).sum(2).astype("<u4")
            yield pd.DataFrame({"node": own["node"], "width": own["width"], "unit": [v.tobytes() for v in x], "cells": [c.tobytes() for c in cells], "cell": cells[:, 0].astype(np.int64), "weight": own["weight"]})


def _means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sum of the unit vectors of each crowded cell."""
    for frame in frames:
        if len(frame):
            yield pd.DataFrame([(w, c, _matrix(own["unit"], int(w)).sum(0)) for (w, c), own in frame.groupby(["width", "cell"])], columns=["width", "cell", "sums"])


def _within(half: float, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for width, own in frame.groupby("width"):
            pivot = np.stack([np.asarray(v, float) for v in own["pivot"]])
            norm = np.sqrt((pivot * pivot).sum(1))
            near = (_matrix(own["unit"], int(width)) * pivot).sum(1) >= math.cos(half) * norm
            yield own.loc[near & (norm > 0), ["node", "core", "crowd"]]


def cores(nodes: DataFrame, bits: int, cosine: float, crowd: int) -> DataFrame:
    """node, core: nodes of one core link with one another. The core's name is its first cell (with the width above it)."""
    spark = nodes.sparkSession
    crowded = nodes.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > crowd)
    width = nodes.agg(F.max("width")).first()[0]
    if not width or crowded.isEmpty():
        return spark.createDataFrame([], "node long, core long")
    sums = nodes.select("width", "cell", "unit").join(crowded, ["width", "cell"]).select("width", "cell", "unit").mapInPandas(_means, "width int, cell long, sums array<double>")
    pivots = sums.groupBy("width", "cell").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("pivot"))
    pivots = pivots.join(crowded, ["width", "cell"]).withColumn("core", F.shiftleft(F.col("width").cast("long"), 32) + F.col("cell")).withColumn("pivot", F.slice("pivot", 1, F.col("width")))
    beside = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])
    asked = pivots.withColumn("flip", F.explode(beside)).withColumn("cell", F.col("cell").bitwiseXOR(F.col("flip"))).drop("flip")
    met = nodes.select("width", "cell", "node", "unit").join(asked, ["width", "cell"]).select("width", "node", "unit", "pivot", "core", "crowd")
    inside = met.mapInPandas(partial(_within, math.acos(cosine) / 2 - SLACK), "node long, core long, crowd long")
    return inside.groupBy("node").agg(F.max_by("core", F.struct("crowd", "core")).alias("core"))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indexes of pairs (a, b) that form a spanning forest of all of them, by Boruvka's rounds."""
    label, at, out = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(at):
        la, lb = label[a[at]], label[b[at]]
        at, la, lb = at[la != lb], la[la != lb], lb[la != lb]
        best = np.full(n, len(a))
        np.minimum.at(best, la, at)
        np.minimum.at(best, lb, at)
        taken = np.unique(best[best < len(a)])
        out.append(taken)
        la, lb = label[a[taken]], label[b[taken]]
        root = np.arange(n)
        while len(taken):
            low = np.minimum(root[la], root[lb])
            before = root.copy()
            np.minimum.at(root, la, low)
            np.minimum.at(root, lb, low)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]
    return np.concatenate(out)


def compare(own: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links that a cell (or two blocks of one) is the first to see: their number a node, and a spanning forest."""
    table, width, cut = int(own["table"].iloc[0]), int(own["width"].iloc[0]), int(own["lo"].iloc[0]) != int(own["hi"].iloc[0])
    own = own.sort_values(["core", "node"], kind="stable", ignore_index=True)
    x, cells = _matrix(own["unit"], width), np.frombuffer(b"".join(own["cells"]), "<u4").reshape(len(own), -1)
    core, weight, block, node = own["core"].to_numpy(), own["weight"].to_numpy(), own["block"].to_numpy(), own["node"].to_numpy()
    links, pairs = np.zeros(len(own), np.int64), []
    for lo in range(0, len(own), TILE):
        for at in range(lo, len(own), TILE):
            if core[lo] >= 0 and core[lo] == core[min(at + TILE, len(own)) - 1]:
                continue  # sorted by core, so both tiles are of one
            i, j = np.nonzero(x[lo : lo + TILE] @ x[at : at + TILE].T >= cosine)
            i, j = i + lo, j + at
            ok = (i < j) & ((core[i] < 0) | (core[i] != core[j]))
            if cut:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            for t in range(table):
                first = cells[i, t] != cells[j, t]
                i, j = i[first], j[first]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            pairs.append(np.stack([i, j])[:, spanning(i, j, len(own))] if len(i) else np.zeros((2, 0), int))
    i, j = np.concatenate([np.zeros((2, 0), int), *pairs], axis=1)
    tree = spanning(i, j, len(own))
    has = np.flatnonzero(links)
    counts = pd.DataFrame({"node": node[has], "links": links[has], "other": pd.array([None] * len(has), "Int64")})
    return pd.concat([counts, pd.DataFrame({"node": node[i[tree]], "links": 0, "other": pd.array(node[j[tree]], "Int64")})], ignore_index=True)


def blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Cells (spot) of up to limit rows are one task's; a larger one is cut into blocks, a core of some size into its own, and a
    row goes to every block that its own must meet: (lo, hi) names the task, block the side."""
    large = materialise(rows.groupBy("spot").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") > limit), "crowded")
    whole = rows.select("*", *[F.lit(0).alias(c) for c in ("lo", "hi", "block")])
    if large.isEmpty():
        return whole
    size = large.agg(F.sum("_in")).first()[0]
    crowded = meet(rows.join(large, "spot", "left_semi"), large.select("spot"), "spot", size)
    own = F.when((F.col("core") >= 0) & (F.col("n") >= limit // 4), F.col("core")).otherwise(F.lit(-1))  # slivers of cores go with the loose rows
    sub = crowded.groupBy("spot", "core").agg(F.count(F.lit(1)).alias("n")).withColumn("part", own)
    parts_ = sub.groupBy("spot", "part").agg(F.sum("n").alias("n"), F.collect_list("core").alias("of")).withColumn("cuts", F.ceil(F.col("n") / limit).cast("int"))
    plan = materialise(parts_.groupBy("spot").agg(F.sort_array(F.collect_list(F.struct("part", "cuts"))).alias("plan")), "plan")  # at most 4 * rows / limit + 1 parts a cell
    named = meet(crowded, plan, "spot", size).withColumn("_part", F.when(F.exists("plan", lambda p: p["part"] == F.col("core")), F.col("core")).otherwise(F.lit(-1)))
    cuts = lambda test: F.aggregate(F.filter("plan", test), F.lit(0), lambda s, p: s + p["cuts"])
    named = named.select("*", cuts(lambda p: p["part"] < F.col("_part")).alias("_base"), cuts(lambda p: p["part"] == F.col("_part")).alias("_cuts"), cuts(lambda p: p["part"] > F.lit(-2)).alias("_all"))
    named = named.withColumn("block", (F.col("_base") + F.pmod(F.xxhash64("node"), F.col("_cuts"))).cast("int"))
    kin = lambda b: (F.col("_part") >= 0) & (b >= F.col("_base")) & (b < F.col("_base") + F.col("_cuts"))
    named = named.withColumn("_to", F.explode(F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda b: ~kin(b))))
    named = named.withColumn("lo", F.least("block", "_to")).withColumn("hi", F.greatest("block", "_to"))
    return whole.join(large, "spot", "left_anti").select(whole.columns).unionByName(named.select(whole.columns))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, miss: float = MISS, limit: int = LIMIT, crowd: int = 2 * CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), x.alias("x"))
    ok = F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists("x", lambda v: v != 0), F.lit(False))
    plain = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are equal
    rows = materialise(rows.select("vec_id", "id", F.when(ok, F.xxhash64(plain, F.size("x"))).alias("node"), F.when(ok, plain).alias("x")), "vectors")
    spark = rows.sparkSession
    distinct = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x")).withColumn("width", F.size("x"))
    widest = distinct.agg(F.max("width")).first()[0] or 1
    limit = min(limit, max(64, TASK_BYTES // (8 * widest)))
    bits, n = tables(distinct.count(), cosine, cell, miss)
    signed = materialise(distinct.select("node", "width", "x", "weight").mapInPandas(partial(_sign, bits, n), "node long, width int, unit binary, cells binary, cell long, weight long"), "signs")
    core = materialise(cores(signed, bits, cosine, crowd), "cores")
    keyed = signed.drop("cell").join(core, "node", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("table")
    one = keyed.select("*", at).withColumn("spot", F.concat_ws(":", "table", "width", F.hex(F.expr("substring(cells, 4 * table + 1, 4)"))))
    dealt = blocks(one, limit)
    found = materialise(dealt.groupBy("spot", "lo", "hi").applyInPandas(lambda own: compare(own, cosine), FOUND), "cell-links")
    counted = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    stars = core.groupBy("core").agg(F.min("node").alias("a"))
    inner = signed.select("node", "weight").join(core, "node").groupBy("core").agg(F.sum("weight").alias("all"))
    held = core.count()
    in_core = meet(core, stars.join(inner, "core"), "core", held)
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(in_core.where("a <> node").select("a", F.col("node").alias("b"))))
    nodes = distinct.select("node", "id", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = materialise(nodes.join(counted, "node", "left").join(in_core.select("node", "all"), "node", "left"), "near-vectors")
    total = nodes.count()
    least = nodes.groupBy("label").agg(F.min("id").alias("component"))
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("all", "weight") - 1
    named = materialise(meet(nodes, least, "label", total).select("node", "component", n_links.cast("long").alias("n_links")), "near-named")
    every = meet(rows.where("node is not null").select("vec_id", "id", "node"), named, "node", rows.count())
    out = every.select("vec_id", "id", "component", "n_links").union(rows.where("node is null").select("vec_id", "id", F.col("id").alias("component"), F.lit(0).cast("long")))
    for gone in (signed, found, nodes):
        forget(spark, gone)
    return out.select("vec_id", "n_links", F.nullif("component", F.lit(LAST)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
