"""Exact links inside families of similar sets, whatever a family's size.

An item is (family, node, t, members): a set of 64-bit elements and a whole number, so that two items of a family are
linked if unit * |A n B| >= t_A + t_B. With t = 2 * percent * |A| and unit = 2 * (100 + percent) that says
100 * |A n B| >= percent * |A u B|.

Flipping a family about its consensus C (the elements that more than half of its sets hold) keeps links: with
d = |C - A|, each set becomes its difference from C, and t becomes t + unit * d - unit / 2 * |C|. Near copies of one text are left with
their own edits only, so sets that agree but don't link have hardly anything in common any more.

Small families are solved in one task: flipped, overlaps counted through the elements that several sets hold, and a spanning
forest of the links comes out (n - 1 rows at most; a refused pair is never a row). A wide family is flipped where its rows lie.
Its head is the set with the smallest t; what needs no shared element to link with the head is its core, linked with it at
once, and pairs inside the core tell nothing new. The other sets ask: blocks of them meet blocks of the family, BLOCK sets or
BYTES of differences each, and overlaps are counted through postings of the elements both hold. No pair is lost on the
way and no family is gathered in one task. Rows are in proportion to the sets up to BLOCK sets outside the core; a family with more of them
sends each to its number of blocks (a third of 2^14, say, costs nothing; 2^20 sets that all refuse each other, 64 rows a set).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, parts
from siltstone.llm.repeats import U

MEMBERS = 1024  # of a family that one task solves
BYTES = 16 << 20
SALTS = 32  # a wide family's items meet what is known about it in so many places
BLOCK = 1 << 14
ITEM = "family long, node long, t long, members binary"


def unit(percent: int) -> int:
    return 2 * (100 + percent)


def overlaps(n: int, element: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many elements each two of n sets share. element, owner: one entry for each element of each set."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(element)]]))
    for c in np.unique(counts[(counts > 1) & (counts <= 16)]):  # few owners: all their pairs
        own = starts[counts == c]
        for at in range(0, len(own), 1 << 14):
            held = owner[own[at : at + (1 << 14), None] + np.arange(c)].astype(np.int64)
            out += np.bincount((held[:, :, None] * n + held[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    many = np.flatnonzero(counts > 16)
    for at in range(0, len(many), 2048):  # many owners: columns of a matrix
        own = many[at : at + 2048]
        m = np.zeros((n, len(own)), np.float32)
        size = counts[own]
        rows = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        m[owner[rows], np.repeat(np.arange(len(own)), size)] = 1
        out += m @ m.T
    return out


def flip(n: int, element: np.ndarray, owner: np.ndarray, t: np.ndarray, unit_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The differences of n sets from their consensus: element, owner, t."""
    values, code, counts = np.unique(element, return_inverse=True, return_counts=True)
    core = np.flatnonzero(2 * counts > n)
    if not len(core):
        return code, owner, t
    place = np.full(len(values), -1)
    place[core] = np.arange(len(core))
    held = place[code] >= 0
    lacks = np.ones((n, len(core)), bool)
    lacks[owner[held], place[code[held]]] = False
    who, which = np.nonzero(lacks)
    t = t + unit_ * lacks.sum(1) - unit_ // 2 * len(core)
    return np.concatenate([code[~held], core[which]]), np.concatenate([owner[~held], who]), t


def forest(linked: Callable[[int, np.ndarray], np.ndarray], n: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among n items. linked(i, others): which of the others i is linked with."""
    left = np.arange(n)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            own = front.pop()
            hit = linked(own, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                front.extend(found.tolist())
                yield from ((int(own), int(x)) for x in found)


def solve(sets: list[np.ndarray], t: np.ndarray, unit_: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a small family, as indexes."""
    n = len(sets)
    if n == 2:
        shared = len(sets[0]) + len(sets[1]) - len(np.union1d(sets[0], sets[1]))
        return [(0, 1)] if unit_ * shared >= t[0] + t[1] else []
    element, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    element, owner, t = flip(n, element, owner, t, unit_)
    shared = overlaps(n, element, owner).astype(np.int64) * unit_
    return list(forest(lambda i, others: shared[i, others] >= t[i] + t[others], n))


def groups(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[pd.DataFrame]:
    """The rows of each group; groups are consecutive, in one partition."""
    held = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        new = np.zeros(len(frame) - 1, bool)
        for c in columns:
            values = frame[c].to_numpy()
            new |= values[1:] != values[:-1]
        cuts = np.flatnonzero(new) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield frame[lo:hi]
        held = frame[cuts[-1] if len(cuts) else 0 :]
    if held is not None and len(held):
        yield held


def _solve(unit_: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for own in groups(frames, "family"):
        if len(own) > 1:
            node = own["node"].to_numpy()
            out += [(node[i], node[j]) for i, j in solve([np.frombuffer(x, "<u8") for x in own["members"]], own["t"].to_numpy(), unit_)]
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def beside(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items after what is known about their family (family, n, base, head, core), which is dealt to each of its salts.
    Only the first row of a salt carries it, so it isn't repeated for each item."""
    blank = {"n": "long", "base": "long", "head": "long", "core": "array<bigint>"}
    left = items.select("family", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("kind"), "node", "t", "members", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    have = [F.col(c).cast(t).alias(c) if c in known.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
    right = known.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("t"), F.lit(b"").alias("members"), *have)
    return left.unionByName(right).repartition(parts(items), "family", "salt").sortWithinPartitions("family", "salt", "kind")


def _each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series | None, pd.DataFrame]]:
    """What is known about the family, and some of its items."""
    key, head = None, None
    for frame in frames:
        family, salt, kind = (frame[c].to_numpy() for c in ("family", "salt", "kind"))
        cuts = np.flatnonzero((np.diff(family, prepend=family[:1]) != 0) | (np.diff(salt, prepend=salt[:1]) != 0)) if len(frame) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(frame)]):
            if lo == hi:
                continue
            if kind[lo] == 0:
                key, head, lo = (family[lo], salt[lo]), frame.iloc[lo], lo + 1
            if lo < hi:
                yield head if key == (family[lo], salt[lo]) else None, frame[lo:hi]


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for head, own in _each(frames):
        yield own[["family", "node", "t", "members"]].assign(wide=head is not None)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for family, own in frame.groupby("family"):
            values, counts = np.unique(np.frombuffer(b"".join(own["members"]), "<u8"), return_counts=True)
            yield pd.DataFrame({"family": family, "element": values.view(np.int64), "c": counts})


def _flip(unit_: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for head, own in _each(frames):
        core = np.sort(np.asarray(head["core"], np.int64).view(U)) if head is not None else np.zeros(0, U)
        sets, t = [], []
        for was, raw in zip(own["t"], own["members"]):
            members = np.frombuffer(raw, "<u8")
            new = np.setxor1d(core, members, assume_unique=True)
            lacks = (len(core) - len(members) + len(new)) // 2
            sets.append(new.astype("<u8").tobytes())
            t.append(was + unit_ * lacks - unit_ // 2 * len(core))
        yield own[["family", "node"]].assign(t=t, members=sets)


def postings(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements in order, where the owners of each begin (and the end), and the owners."""
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    return element[starts], np.concatenate([starts, [len(element)]]), owner


def meet(asks: list[np.ndarray], ours: np.ndarray, home: list[np.ndarray], theirs: np.ndarray, unit_: int, labels: np.ndarray, tile: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Links of sets that ask with sets at home, one for each two labels they bring together. labels: of asks, then of home."""
    n = len(home)
    values, starts, owner = postings(np.concatenate(home), np.repeat(np.arange(n), [len(s) for s in home]))
    rows = max(1, tile // n)
    for lo in range(0, len(asks), rows):
        own = asks[lo : lo + rows]
        element, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own])
        at = np.minimum(np.searchsorted(values, element), max(len(values) - 1, 0))
        hit = values[at] == element if len(values) else np.zeros(len(element), bool)
        at, row = at[hit], row[hit]
        shared = np.zeros(len(own) * n, np.int64)
        size = starts[at + 1] - starts[at]
        cuts = np.searchsorted(np.cumsum(size), np.arange(tile, size.sum() + tile, tile))
        for b, e in zip([0, *cuts], [*cuts, len(at)]):  # a bounded number of meetings at a time
            k = size[b:e]
            who = owner[np.repeat(starts[at[b:e]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            shared += np.bincount(np.repeat(row[b:e], k) * n + who, minlength=len(shared))
        linked = unit_ * shared.reshape(len(own), n) >= ours[lo : lo + rows, None] + theirs[None, :]
        for i in np.flatnonzero(linked.any(1)):
            found = np.flatnonzero(linked[i])
            names, first = np.unique(labels[len(asks) + found], return_index=True)
            for name, j in zip(names, found[first]):
                mine = labels[lo + i]
                if labels[len(asks) + j] != mine:
                    labels[labels == labels[len(asks) + j]] = mine
                    yield lo + int(i), int(j)


def _meet(unit_: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in groups(frames, "family", "i", "j"):
        asks, home = own[own["asks"]], own[~own["asks"]]
        if len(asks) and len(home):
            nodes = [asks["node"].to_numpy(), home["node"].to_numpy()]
            labels = np.unique(np.concatenate(nodes), return_inverse=True)[1]
            core = np.concatenate([np.zeros(len(asks), bool), home["core"].to_numpy()])
            labels[core] = len(labels)
            sets = [[np.frombuffer(x, "<u8") for x in side["members"]] for side in (asks, home)]
            out = [(nodes[0][i], nodes[1][j]) for i, j in meet(sets[0], asks["t"].to_numpy(), sets[1], home["t"].to_numpy(), unit_, labels)]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items with the head of their family, the number of its blocks, and whether they are in its core."""
    for head, own in _each(frames):
        yield own[["family", "node", "t", "members"]].assign(head=head["head"], blocks=head["n"], core=(own["t"] + head["base"] <= 0) | (own["node"] == head["head"]))


def _wide_links(held: DataFrame, unit_: int, block: int, n: int) -> list[DataFrame]:
    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    counts = held.mapInPandas(_count, "family long, element long, c long").groupBy("family", "element").agg(F.sum("c").alias("c")).where("c > 1")
    core = counts.join(sizes, "family").where(2 * F.col("c") > F.col("n")).groupBy("family").agg(F.collect_list("element").alias("core"))  # twice a set's elements at most
    core = materialise(sizes.select("family").join(core, "family", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>"))), "families-core")
    flipped = materialise(beside(held, core).mapInPandas(partial(_flip, unit_), ITEM), "families", "lz4")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("members")) / BYTES))
    known = flipped.groupBy("family").agg(F.min(F.struct("t", "node")).alias("m"), blocks.alias("n")).select("family", "n", F.col("m.t").alias("base"), F.col("m.node").alias("head"))
    told = materialise(beside(flipped, known).mapInPandas(_told, ITEM + ", head long, blocks long, core boolean"), "families-told", "lz4")
    stars = told.where("core and node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["family", "i", "j", "node", "t", "members", "core", "asks"]
    asks = told.where("not core").withColumn("i", own).withColumn("asks", F.lit(True)).withColumn("j", every).select(*columns)
    home = told.withColumn("j", own).withColumn("asks", F.lit(False)).withColumn("i", every).select(*columns)
    # blocks that nobody asks have nothing to do
    open_ = asks.select("family", "i").distinct()
    met = asks.unionByName(home.join(open_, ["family", "i"], "left_semi").select(*columns))
    return [stars, met.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(partial(_meet, unit_), "a long, b long")]


def family_links(items: DataFrame, percent: int, members: int | None = None, block: int | None = None) -> DataFrame:
    """items: see ITEM. a, b: links that give the components of all links of each family."""
    unit_, most = unit(percent), members or MEMBERS
    held = materialise(items, "families", "lz4")
    n = parts(held)
    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("members")).alias("bytes"))
    wide = materialise(sizes.where((F.col("n") > most) | ((F.col("bytes") > BYTES) & (F.col("n") > 2))).select("family", "n"), "families-wide")
    found = []
    if not wide.isEmpty():
        split = materialise(beside(held, wide).mapInPandas(_split, ITEM + ", wide boolean"), "families", "lz4")
        found = _wide_links(split.where("wide").drop("wide"), unit_, block or BLOCK, n)
        held = split.where("not wide").drop("wide")
    found.append(held.repartition(n, "family").sortWithinPartitions("family").mapInPandas(partial(_solve, unit_), "a long, b long"))
    return materialise(reduce(DataFrame.unionByName, found), "families-links")
