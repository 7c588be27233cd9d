"""Packing token sequences into bins by minimum bin slack.

Lengths are whole numbers up to the capacity, so a histogram of them (capacity rows at most) says all that the choice
of bins needs. Each bin starts with the longest length left; a subset-sum over the other available lengths, a bitset
held in one integer, finds the fullest total that fits, and the combination is removed. A combination is used
as often as the counts allow, so the number of distinct combinations is bounded by the capacity (at most
sum over lengths of capacity / length), not by the documents. Documents get their place by their rank among the
pieces of their length: a rank within the task that wrote them plus a running sum of the tasks' counts.

Defined cases: null text is the empty text, which is one piece of the end id; rows that repeat an id are packed
each by itself; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialise
from siltstone.llm.tokens import encoder

RESERVES = (4, 5, 6, 8, 12, 10**9)  # shares of the capacity; the last keeps no length back
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def fullest(counts: dict[int, int], capacity: int, longest: int | None = None) -> list[tuple[int, int]]:
    """The fullest combination of available lengths, longest first as far as that is free; with the longest length in it if
    one is given: (length, how often)."""
    room = capacity - (longest or 0)
    left = {n: min(c - (n == longest), room // n) for n, c in counts.items() if n <= room and c - (n == longest) > 0}
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in sorted(left, reverse=True):  # each length as often as it fits, in powers of two
        many, size = left[n], 1
        while many:
            size = min(size, many)
            steps.append((n, size, reach))
            reach |= (reach << n * size) & mask
            many, size = many - size, size * 2
        if reach >> room & 1:
            break
    best, took = reach.bit_length() - 1, defaultdict(int, {longest: 1} if longest else {})
    for n, size, before in reversed(steps):
        if not before >> best & 1:
            took[n] += size
            best -= n * size
    return sorted(took.items(), reverse=True)


def _take(counts: dict[int, int], chosen: list[tuple[int, int]], times: int) -> None:
    for n, k in chosen:
        counts[n] -= k * times
        if not counts[n]:
            del counts[n]


def _fill(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins by minimum slack: (number of bins, combination)."""
    out = []
    while counts:
        chosen = fullest(counts, capacity, max(counts))
        times = min(counts[n] // k for n, k in chosen)
        out.append((times, chosen))
        _take(counts, chosen, times)
    return out


def plan_with(counts: dict[int, int], capacity: int, reserve: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins of the lengths from reserve on; the shorter ones then fill what is free, least slack first, and bins of their own."""
    long, short = ({n: c for n, c in counts.items() if c and (n >= reserve) == side} for side in (True, False))
    out = []
    open_ = _fill(long, capacity)
    open_.sort(key=lambda x: capacity - sum(n * k for n, k in x[1]))
    for times, chosen in open_:
        room = capacity - sum(n * k for n, k in chosen)
        while times and short and room >= min(short):
            more = fullest(short, room)
            now = min(times, *(short[n] // k for n, k in more))
            _take(short, more, now)
            out.append((now, chosen + more))
            times -= now
        if times:
            out.append((times, chosen))
    return out + _fill(short, capacity)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Bins for so many pieces of each length: (first bin, number of bins, combination). Full bins at first use up the short
    lengths that the last bins need, so some shares of the capacity are tried as the length from which on bins are formed."""
    tried = [plan_with(counts, capacity, capacity // part) for part in RESERVES]
    best, out, bins = min(tried, key=lambda bins: sum(times for times, _ in bins)), [], 0
    for times, chosen in best:
        out.append((bins, times, chosen))
        bins += times
    return out


def places(bins: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where ranks begin, first bin, how often in a bin, offset in it."""
    by, seen = defaultdict(list), defaultdict(int)
    for first, times, chosen in bins:
        offset = 0
        for n, k in chosen:
            by[n].append((seen[n], first, k, offset))
            seen[n] += k * times
            offset += n * k
    return {n: tuple(np.asarray(x, np.int64) for x in zip(*rows)) for n, rows in by.items()}


def token_pieces(docs: DataFrame, vocabulary: str, kind: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each document, written to the shared folder; nth: rank among the task's pieces of its length."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, task, seen, end = encoder(vocabulary, kind), TaskContext.get().partitionId(), defaultdict(int), np.asarray([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, (lo, hi) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    rows.append((doc, piece, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), task, seen[hi - lo]))
                    seen[hi - lo] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(rows.mapInPandas(cut, PIECES), "pieces")


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece. Only a document longer than the
    capacity is cut; its first piece may be shorter than the others, which fill their sequences."""
    pieces = token_pieces(docs, vocabulary, kind, end_id, capacity, id_col, text_col)
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    spots = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            bins, offsets = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                begin, first, times, at = spots[int(n)]
                k = np.searchsorted(begin, rank[own], "right") - 1
                j = rank[own] - begin[k]
                bins[own], offsets[own] = first[k] + j // times[k], at[k] + j % times[k] * n
            frame["sequence_id"], frame["offset"] = bins, offsets
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
