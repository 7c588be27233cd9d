"""Suffix-array dedup of byte strings, built blockwise with a difference cover.

Two suffixes matter to each other if their first `window` bytes agree. Suffixes go into buckets by their anchor, which
equal windows share (repeats.py); equal contexts are collapsed, and buckets with one context left need no sorting. The
others are sorted one block of buckets at a time: suffixes are ordered by their first v bytes; where those agree (long ties), the
ranks of a cover sample decide, and then the last v bytes of the window. The sample holds the places whose residue
modulo v is in a difference cover, ranked once for each block by their next window - v bytes: for any two suffixes
some d < v leads to sampled places in both, and the ranks there compare all bytes between the two ends. A block holds a
few MB, so memory is bounded; a bucket too crowded for one owner is settled by hashes of whole windows.

Texts are UTF-8 bytes; matches never cross texts. A byte goes if a window that covers it also starts earlier: in a
smaller id, or earlier in the same text. Defined cases: null text is empty; of equal texts the one with the smallest
id is first and the others go as a whole if they hold a window; rows that repeat id and text are one text and all stay;
texts that share an id are ordered by a hash; null ids come last; kept bytes need not be valid UTF-8; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, materialise, parts
from siltstone.llm.repeats import REPLY, TEXTS, U, Batch, Spans, Windows, columns_of, distinct_texts, finish, keyed, mixed, pairs_of, planes, replies, spread, unify

BYTES = mixed(np.arange(1, 257, dtype=U) * U(0xC2B2AE3D27D4EB4F))
CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set modulo 31
BLOCK = 1 << 20
OPEN = {"k": "<u8", "text": "<u4", "lo": "<u4", "n": "<u2"}


def steps() -> np.ndarray:
    """For two residues: the least d that takes both into the cover."""
    inside = np.isin(np.arange(CYCLE), COVER)
    d = np.arange(CYCLE)
    both = inside[(d[:, None, None] + d[None, :, None]) % CYCLE] & inside[(d[:, None, None] + d[None, None, :]) % CYCLE]
    return both.argmax(0)


STEPS = steps()


def sequence(texts: list[bytes]) -> Batch:
    return Batch(BYTES[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)]))


def text_words(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The CYCLE bytes from each place on as numbers that order as the bytes do, a row each."""
    cells = np.lib.stride_tricks.sliding_window_view(raw, 8)
    starts = [*range(0, CYCLE - 8, 8), CYCLE - 8]
    return np.stack([np.ascontiguousarray(cells[places + at]).view(">u8").ravel().astype(U) for at in starts])


def suffix_order(data: bytes, places: np.ndarray, buckets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (places in data, in buckets) sorted by bucket and their first `window` bytes (zeros behind the end), and in that
    order which of them differs from the one before it.

    Buckets and the first v bytes are sorted at once. Runs that agree on them, the long ties, are split in three about their first suffix,
    all runs in one step, until each holds equals only: the sample's ranks at a common distance d compare all bytes but the last v - d,
    and the last v bytes decide what the ranks leave."""
    raw = np.frombuffer(data + bytes(window + 8), np.uint8)
    long = window - CYCLE
    sampled = np.flatnonzero(np.isin(np.arange(len(data)) % CYCLE, COVER))
    cells = np.lib.stride_tricks.sliding_window_view(raw, long)[sampled]
    rank = np.zeros(len(raw), np.int64)
    rank[sampled] = np.unique(np.ascontiguousarray(cells).view(f"V{long}").ravel(), return_inverse=True)[1]
    head = text_words(raw, places)
    order = np.lexsort((*head[::-1], buckets))
    at, head = places[order], head[:, order]
    run = np.cumsum(np.concatenate([[True], (buckets[order][1:] != buckets[order][:-1]) | (head[:, 1:] != head[:, :-1]).any(0)])) - 1
    sizes = np.bincount(run, minlength=len(order))
    work = np.flatnonzero(sizes[run] > 1)  # of the sorted suffixes
    # where in its run a suffix goes: runs are kept apart by where they begin, and split runs begin behind what precedes them
    begin = np.searchsorted(run, run)
    fresh = np.concatenate([[True], run[1:] != run[:-1]])
    tail = np.lexsort(text_words(raw, at[work] + long)[::-1]) if len(work) else work
    tails = np.zeros(len(order), np.int64)
    if len(work):
        words = text_words(raw, at[work[tail]] + long)
        tails[work[tail]] = np.cumsum(np.concatenate([[False], (words[:, 1:] != words[:, :-1]).any(0)]))
    while len(work):
        key = begin[work]
        lead = work[np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])[np.cumsum(np.concatenate([[False], np.diff(key) != 0]))]]
        d = STEPS[at[lead] % CYCLE, at[work] % CYCLE]
        side = np.sign(rank[at[work] + d] - rank[at[lead] + d])
        side = np.where(side == 0, np.sign(tails[work] - tails[lead]), side)
        parts = np.lexsort((side, key))
        moved, key, side = work[parts], key[parts], side[parts]
        # the suffixes of a run change places among themselves
        order[work], at[work], tails[work] = order[moved], at[moved], tails[moved]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
        fresh[work[first]] = True
        begin[work] = work[np.flatnonzero(first)[np.cumsum(first) - 1]]
        work = work[side != 0]
    return order, fresh


def _ship(window: int, k: int, owners: int):
    """Deals the bytes of open contexts to the owners of their anchors."""
    find = Windows(window, (k,), "later", sequence)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, batch in find.batches(frames):
            ranges = [pairs_of(x) for x in own["ranges"]]
            text = np.repeat(np.arange(len(own)), [len(x) for x in ranges])
            ranges = np.concatenate(ranges)
            lo, n = ranges[:, 0], ranges[:, 1]
            at = lo + batch.starts[text]
            key = anchors_of(batch, at, at + n, window, k)
            owner = ((key >> U(40)) % U(owners)).astype(np.int64)
            order = np.lexsort((text, owner))
            cuts = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
            whole = list(own["text"])
            out = []
            for b, e in zip(cuts[:-1], cuts[1:]):
                i = order[b:e]
                named, local = np.unique(text[i], return_inverse=True)
                out.append((int(owner[i[0]]), planes({c: own[c].to_numpy()[named] for c in TEXTS}, TEXTS), planes({"k": key[i], "text": local, "lo": lo[i], "n": n[i]}, OPEN),
                            b"".join(whole[text[j]][lo[j] : lo[j] + n[j] + window] for j in i)))
            yield pd.DataFrame(out, columns=["owner", "texts", "rows", "bytes"])

    return run


def anchors_of(batch: Batch, first: np.ndarray, last: np.ndarray, window: int, k: int) -> np.ndarray:
    """The hash of the anchor that serves windows first to last."""
    from siltstone.llm.repeats import contexts

    _, anchor, lo, _ = contexts(batch, window, k, window - k + 1)
    at = anchor[np.searchsorted(lo, first, "right") - 1]
    return batch.spans.of(at, at + k)


def _sort(window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, rows, data, base = [], [], [], 0
        for r in frame.itertuples():
            own, cols = columns_of(r.texts, TEXTS), columns_of(r.rows, OPEN)
            cols["text"] = cols["text"].astype(np.int64) + base
            base += len(own["t"])
            texts.append(own), rows.append(cols), data.append(r.bytes)
        texts = {c: np.concatenate([t[c] for t in texts]) for c in TEXTS}
        rows = {c: np.concatenate([r[c] for r in rows]) for c in OPEN}
        texts, rows = unify(texts, rows)
        data = b"".join(data)
        size = rows["n"].astype(np.int64) + window
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.argsort(rows["k"], kind="stable")
        new = np.concatenate([[True], np.diff(rows["k"][order]) != 0])
        bucket = np.cumsum(new) - 1
        ends = np.cumsum(size[order])
        block = (ends[np.flatnonzero(new)] // BLOCK)[bucket]  # whole buckets
        out = []
        for b in np.unique(block):
            i = order[block == b]
            chunk = b"".join(data[begin[j] : begin[j] + size[j]] for j in i)
            starts = np.concatenate([[0], np.cumsum(size[i])[:-1]])
            n = rows["n"][i].astype(np.int64) + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(np.arange(len(i)), n)
            text, lo = rows["text"][i][of], rows["lo"][i][of].astype(np.int64) + step
            order_, fresh = suffix_order(chunk, starts[of] + step, bucket[block == b][of], window)
            group = np.empty(len(order_), np.int64)
            group[order_] = np.cumsum(fresh)
            by = np.lexsort((lo, text, group))
            again = np.concatenate([[False], group[by][1:] == group[by][:-1]])
            own = {"text": text[by][again], "lo": lo[by][again]}
            out.append(own)
        rows = {c: np.concatenate([x[c] for x in out]) for c in ("text", "lo")}
        return replies(texts, rows, done=np.ones(len(rows["lo"]), bool))

    return run


def repeated_bytes(docs: DataFrame, window: int = 100, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    find = Windows(window, (k,), "later", sequence)
    rows = keyed(docs, id_col, text_col)
    texts = distinct_texts(rows)
    found = find.find(texts)
    owners = parts(texts, 32 << 20)
    opened = found.select("t", "u", F.col("open").alias("ranges")).where("size(ranges) > 0")
    shipped = materialise(texts.join(opened, ["t", "u"]).mapInPandas(_ship(window, k, owners), "owner int, texts binary, rows binary, bytes binary"), "suffix-buckets")
    sorted_ = materialise(shipped.groupBy("owner").applyInPandas(_sort(window), REPLY).select("t", "u", "done"), "suffix-done")
    forget(docs.sparkSession, shipped)
    crowded = found.select("t", "u", F.col("crowded").alias("ranges")).where("size(ranges) > 0")
    hashed = find.settle_windows(texts, crowded).select("t", "u", "done")
    covered = found.select("t", "u", "done").where("size(done) > 0").unionByName(sorted_.unionByName(hashed).select("t", "u", F.array("done").alias("done")))
    def each(raw: bytes, pairs: np.ndarray, whole: bool) -> tuple:
        n = len(raw)
        gone = np.ones(n, bool) if whole and n >= window else spread(pairs, n, window)
        kept = np.frombuffer(raw, np.uint8)[~gone] if gone.any() else raw
        return n, n - len(kept), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()

    every = finish(rows, texts, covered, each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return every.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
