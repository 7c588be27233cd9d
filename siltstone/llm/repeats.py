"""Windows of a fixed length that occur more than once in a corpus, whatever the corpus' size.

A document is a sequence (of bytes, or of words). A window of W items is looked up through its anchor: among the k-grams that
start in its first `reach` items, the one with the smallest hash (the first of equals). Equal windows have equal anchors at
equal offsets, and neighbouring windows share an anchor, so a document has about 2 / (reach + 1) anchors an item. An anchor's
context is the span of all windows it serves; equal contexts mean that all those windows are equal.

1. survivors: rounds over growing lengths. A task deals each anchor's run of that length once to the owner of its hash; what occurs
   nowhere else is gone, and only the rest is looked at at the next length.
2. find: every task collapses equal contexts it has itself, and deals one of each to the owner of its k-gram (of the last level).
   The owner settles contexts that occur again. What is left are k-grams with several different contexts, whose
   windows may still be equal in part (edges of passages): one of each such context is open.
3. Windows of open contexts are compared one by one, through hashes of the whole window (settle_windows here), or by
   the caller's own means. A k-gram with so many contexts in one task that its owner would be flooded always goes by hashes.

Tasks collapse what they can before they deal, so an owner gets a few rows a task of any key, however frequent. All
results are keyed by text (two hashes of it), so copies of a text are one text, and a
retried task gives the same rows. Spans are hashed to 96 bits, k-grams to 64.

mode "all": every window that also starts elsewhere is reported; "later": every one but the first, in order of
(id, text, start).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, materialise, parts

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93))
PLACE_BITS = 28
BATCH_BYTES = 1 << 20
FLUSH = 1 << 18  # records
CROWD = 4  # contexts of one k-gram that a task deals to its owner; with more it calls the k-gram crowded
LAST = 2**63 - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse for i < n, modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(BASES[which])
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(max(n, BATCH_BYTES + (1 << 16)), b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[which] = tuple(out)
    return _powers[which]


class Spans:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums of value * base^place."""

    def __init__(self, values: np.ndarray, two: bool = True):
        self.sums, n = [], len(values)
        for which in range(1 + two):
            s = np.zeros(n + 1, U)
            np.cumsum(values * powers(which, n + 1)[0][:n], out=s[1:])
            self.sums.append(s)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return mixed((self.sums[which][end] - self.sums[which][begin]) * powers(which, len(self.sums[which]))[1][begin])

    def all(self, k: int) -> np.ndarray:
        """Of every run of k."""
        s = self.sums[0]
        return mixed((s[k:] - s[:-k]) * powers(0, len(s))[1][: len(s) - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(x)
    rows = -(-n // w)
    a = np.full(rows * w, np.iinfo(U).max, U)
    a[:n] = x
    a = a.reshape(rows, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


@dataclass
class Batch:
    """Texts as one sequence: values, where each text begins (and the end), span hashes."""

    values: np.ndarray
    starts: np.ndarray
    spans: Spans = field(init=False)

    def __post_init__(self):
        self.spans = Spans(self.values)


def contexts(batch: Batch, window: int, k: int, reach: int) -> tuple[np.ndarray, ...]:
    """text, anchor, first and last window (places in the batch) of each anchor."""
    n = len(batch.values)
    valid = np.zeros(max(n - window + 2, 1), np.int32)
    begin, end = batch.starts[:-1], batch.starts[1:] - window + 1
    has = end > begin
    if not has.any():
        return (np.zeros(0, np.int64),) * 4
    np.add.at(valid, begin[has], 1)
    np.add.at(valid, end[has], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    low = U((1 << PLACE_BITS) - 1)
    grams = batch.spans.all(k) & ~low
    places = np.arange(len(grams), dtype=U)
    if len(grams) > int(low):  # places don't fit beside the hashes: their order among themselves does
        low = U((1 << len(grams).bit_length()) - 1)
        grams = np.unique(grams, return_inverse=True)[1].astype(U) << U(len(grams).bit_length())
    anchor = (sliding_min(grams | places, reach)[at] & low).astype(np.int64)
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = at[np.concatenate([[0], edge])], at[np.concatenate([edge - 1, [len(at) - 1]])]
    anchor = anchor[np.concatenate([[0], edge])]
    return np.searchsorted(batch.starts, first, "right") - 1, anchor, first, last


# Records travel as columns of byte planes: high bytes that hardly vary then compress to nothing.
CONTEXT = {"k": "<u8", "a": "<u8", "b": "<u4", "text": "<u4", "lo": "<u4", "n": "<u2", "crowded": "<u1"}
OPEN = {"a": "<u8", "b": "<u4", "text": "<u4", "lo": "<u4"}
TEXTS = {"t": "<i8", "u": "<i4", "id": "<i8"}


def planes(columns: dict[str, np.ndarray], types: dict[str, str]) -> bytes:
    return b"".join(np.ascontiguousarray(columns[c], t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for c, t in types.items())


def columns_of(raw: bytes, types: dict[str, str]) -> dict[str, np.ndarray]:
    wide = [np.dtype(t).itemsize for t in types.values()]
    n, out, at = len(raw) // sum(wide), {}, 0
    for (c, t), w in zip(types.items(), wide):
        out[c] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T.copy().view(t).ravel()
        at += n * w
    return out


def deal(texts: dict[str, np.ndarray], rows: dict[str, np.ndarray], key: np.ndarray, types: dict[str, str], owners: int) -> Iterator[dict]:
    """The rows for each owner of a key, with the texts they name."""
    owner = ((key >> U(40)) % U(owners)).astype(np.int64)
    order = np.lexsort((rows["text"], owner))
    cuts = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = {c: rows[c][order[lo:hi]] for c in types}
        named, own["text"] = np.unique(own["text"], return_inverse=True)
        yield {"owner": int(owner[order[lo]]), "texts": planes({c: texts[c][named] for c in TEXTS}, TEXTS), "rows": planes(own, types)}


def gather(frame: pd.DataFrame, types: dict[str, str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Texts, each once, and rows of all that was dealt to an owner."""
    texts, rows, base = [columns_of(x, TEXTS) for x in frame["texts"]], [columns_of(x, types) for x in frame["rows"]], 0
    for t, r in zip(texts, rows):
        r["text"] = r["text"].astype(np.int64) + base
        base += len(t["t"])
    texts = {c: np.concatenate([t[c] for t in texts]) for c in TEXTS}
    rows = {c: np.concatenate([r[c] for r in rows]) for c in types}
    return unify(texts, rows)


def unify(texts: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Numbers texts in order of (id, hashes), equal texts once, by their smallest id."""
    by_text = np.lexsort((texts["id"], texts["u"], texts["t"]))
    t, u = texts["t"][by_text], texts["u"][by_text]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (u[1:] != u[:-1])]) if len(t) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    kept = by_text[new]
    order = np.lexsort((texts["u"][kept], texts["t"][kept], texts["id"][kept]))
    rank = np.empty(len(kept), np.int64)
    rank[order] = np.arange(len(kept))
    number = np.empty(len(t), np.int64)
    number[by_text] = rank[group]
    rows["text"] = number[rows["text"]]
    return {c: texts[c][kept][order] for c in TEXTS}, rows


def settle(rows: dict[str, np.ndarray], mode: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of (hashes, text, place), each once; which of them are settled as repeated; the first of each group."""
    order = np.lexsort((rows["lo"], rows["text"], rows["b"], rows["a"]))
    rows = {c: v[order] for c, v in rows.items()}
    a, b, text, lo = (rows[c] for c in ("a", "b", "text", "lo"))
    if not len(a):
        return rows, np.zeros(0, bool), np.zeros(0, np.int64)
    other = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    fresh = other | np.concatenate([[True], (text[1:] != text[:-1]) | (lo[1:] != lo[:-1])])
    if "crowded" in rows:  # of rows that say the same, one that calls its k-gram crowded counts
        rows["crowded"] = np.maximum.reduceat(rows["crowded"], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    rows, other = {c: v[fresh] for c, v in rows.items()}, other[fresh]
    firsts = np.flatnonzero(other)
    sizes = np.diff(np.concatenate([firsts, [len(other)]]))
    return rows, ~other if mode == "later" else np.repeat(sizes > 1, sizes), firsts


REPLY = "t long, u int, id long, done binary, open binary, crowded binary"
NO_REPLY = {"done": b"", "open": b"", "crowded": b""}


def replies(texts: dict[str, np.ndarray], rows: dict[str, np.ndarray], **flags: np.ndarray) -> pd.DataFrame:
    """For each text: the (first window, further windows) of rows with each flag, as pairs of 32-bit numbers."""
    n = rows.get("n", np.zeros(len(rows["lo"]), np.int64))
    out: dict[int, dict] = {}
    for name, flag in flags.items():
        own = np.flatnonzero(flag)
        own = own[np.argsort(rows["text"][own], kind="stable")]
        if not len(own):
            continue
        pairs = np.column_stack([rows["lo"][own], n[own]]).astype("<u4")
        cuts = np.flatnonzero(np.diff(rows["text"][own], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            out.setdefault(int(rows["text"][own[lo]]), dict(NO_REPLY))[name] = pairs[lo:hi].tobytes()
    at = np.fromiter(out, np.int64, len(out))
    frame = pd.DataFrame({c: texts[c][at] for c in TEXTS})
    return frame.assign(**{c: [x[c] for x in out.values()] for c in NO_REPLY})


def pairs_of(raw) -> np.ndarray:
    """(first window, further windows) rows of replies."""
    return np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64) if raw is not None else np.zeros((0, 2), np.int64)


@dataclass(frozen=True)
class Windows:
    """window, mode: see above. levels: the lengths at which anchors are looked up, a round each; only what repeats
    at one length is looked at at the next, and what repeats at the last at the length of the window. sequence: makes
    a batch of texts (as bytes)."""

    window: int
    levels: tuple[int, ...]
    mode: str
    sequence: Callable[[list[bytes]], Batch]

    @property
    def reach(self) -> int:
        """Anchors of which the longest level lies in the window."""
        return self.window - self.levels[-1] + 1

    def batches(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Batch]]:
        """Rows of a few MB of text, and their sequences."""
        for frame in frames:
            sizes = frame["text"].map(len).to_numpy()
            group = np.cumsum(sizes) // BATCH_BYTES if len(frame) else sizes
            for _, own in frame.groupby(group, sort=True):
                yield own, self.sequence(list(own["text"]))

    def _survey(self, owners: int):
        types = CONTEXT

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, count = [], 0

            def flush() -> Iterator[pd.DataFrame]:
                texts, rows, base = {c: np.concatenate([h[0][c] for h in held]) for c in TEXTS}, {}, 0
                for t, r in held:
                    r["text"] = r["text"] + base
                    base += len(t["t"])
                rows = {c: np.concatenate([h[1][c] for h in held]) for c in types}
                texts, rows = unify(texts, rows)
                rows, done, firsts = settle(rows, self.mode)
                grams, of, many = np.unique(rows["k"][firsts], return_inverse=True, return_counts=True)
                crowd = np.zeros(len(done), bool)
                crowd[firsts] = (many > CROWD)[of]
                order = np.argsort(of, kind="stable")
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                rows["crowded"] = crowd.astype(np.uint8)
                sent = firsts[(nth < 2) | ~crowd[firsts]]
                found = replies(texts, rows, done=done, crowded=crowd)
                if len(found):
                    yield found.assign(owner=-1, texts=b"", rows=b"")
                out = pd.DataFrame(deal(texts, {c: rows[c][sent] for c in types}, rows["k"][sent], types, owners))
                if len(out):
                    yield out.assign(t=0, u=0, id=0, **NO_REPLY)

            for own, batch in self.batches(frames):
                text, anchor, first, last = contexts(batch, self.window, self.levels[0], self.reach)
                if "spots" in own:
                    alive = np.isin((text << 40) | (anchor - batch.starts[text]), _spots(own))
                    text, anchor, first, last = text[alive], anchor[alive], first[alive], last[alive]
                end, shape = last + self.window, mixed(((anchor - first).astype(U) << U(32)) | (last - first).astype(U))
                rows = {"k": batch.spans.of(anchor, anchor + self.levels[-1]), "a": batch.spans.of(first, end) ^ shape, "b": (batch.spans.of(first, end, 1) >> U(32)).astype(np.uint32),
                        "text": text, "lo": first - batch.starts[text], "n": last - first, "crowded": np.zeros(len(text), np.uint8)}
                held.append(({c: own[c].to_numpy() for c in TEXTS}, rows))
                count += len(text)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
            if held:
                yield from flush()

        return run

    def _own(self, frame: pd.DataFrame) -> pd.DataFrame:
        texts, rows = gather(frame, CONTEXT)
        rows, done, firsts = settle(rows, self.mode)
        # any row tells that its k-gram is crowded: the first of a context may come from a flush where it isn't
        grams, of = np.unique(rows["k"], return_inverse=True)
        crowd = np.zeros(len(grams), np.uint8)
        np.maximum.at(crowd, of, rows["crowded"])
        of = of[firsts]
        many = np.bincount(of, minlength=len(grams))
        opened, crowded = np.zeros(len(done), bool), np.zeros(len(done), bool)
        crowded[firsts] = (crowd > 0)[of]
        opened[firsts[((many > 1) & (crowd == 0))[of]]] = True
        return replies(texts, rows, done=done, open=opened, crowded=crowded)

    def survivors(self, texts: DataFrame) -> DataFrame | None:
        """The rounds before the last level: t, u, spots (array of binaries: places of anchors that repeat at every length so far).
        None if there is no such round; empty as soon as nothing survives a length."""
        alive = None
        for length in self.levels[:-1]:
            rows = texts if alive is None else texts.join(alive, ["t", "u"])
            found = self._compared(rows, length)
            alive = materialise(found.where(F.length("done") > 0).groupBy("t", "u").agg(F.collect_list("done").alias("spots")), "repeats-alive")
            if alive.isEmpty():
                break
        return alive

    def find(self, texts: DataFrame) -> DataFrame:
        """texts: t, u, id, text (binary). A row a text: t, u, id, and what is done, open and crowded, as arrays of binaries."""
        owners = parts(texts, 32 << 20)
        shape = f"owner int, texts binary, rows binary, {REPLY}"
        alive = self.survivors(texts)
        rows = texts if alive is None else texts.join(alive, ["t", "u"])
        dealt = materialise(rows.mapInPandas(self._survey(owners), shape), "repeats-dealt", "lz4")
        owned = dealt.where("owner >= 0").select("owner", "texts", "rows").groupBy("owner").applyInPandas(lambda frame: self._own(frame), REPLY)
        local = dealt.where("owner < 0").select("t", "u", "id", "done", "open", "crowded")
        found = materialise(by_text(owned.unionByName(local)), "repeats-found")
        forget(texts.sparkSession, dealt)
        return found

    def settle_windows(self, texts: DataFrame, opened: DataFrame) -> DataFrame:
        """opened: t, u, ranges (array of binaries). Compares each window of the ranges with all others by a hash of its items.
        t, u, done: the repeated ones."""
        return self._compared(texts.join(opened, ["t", "u"]), self.window).select("t", "u", "done")

    def _compared(self, rows: DataFrame, length: int) -> DataFrame:
        """Runs of one length that occur more than once, from places that the rows name (ranges or spots) or else from all anchors."""
        owners = parts(rows, 32 << 20)
        dealt = materialise(rows.mapInPandas(self._open(owners, length), f"owner int, texts binary, rows binary, {REPLY}"), "repeats-open", "lz4")
        owned = dealt.where("owner >= 0").select("owner", "texts", "rows").groupBy("owner").applyInPandas(lambda frame: self._own_windows(frame, length), REPLY)
        found = materialise(owned.unionByName(dealt.where("owner < 0").select("t", "u", "id", "done", "open", "crowded")).select("t", "u", "done"), "repeats-compared")
        forget(rows.sparkSession, dealt)
        return found

    def _places(self, own: pd.DataFrame, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """text, place of what is to be compared."""
        if "ranges" in own:
            ranges = [pairs_of(x) for x in own["ranges"]]
            text = np.repeat(np.arange(len(own)), [len(x) for x in ranges])
            ranges = np.concatenate(ranges)
            n = ranges[:, 1] + 1
            return np.repeat(text, n), np.repeat(ranges[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if "spots" in own:
            codes = _spots(own)
        else:
            text, anchor, _, _ = contexts(batch, self.window, self.levels[0], self.reach)
            codes = np.unique((text << 40) | (anchor - batch.starts[text]))
        return codes >> 40, codes & ((1 << 40) - 1)

    def _open(self, owners: int, length: int):
        mode = self.mode if length == self.window else "all"  # before the last length every occurrence survives

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for own, batch in self.batches(frames):
                text, place = self._places(own, batch)
                at = place + batch.starts[text]
                rows = {"a": batch.spans.of(at, at + length), "b": (batch.spans.of(at, at + length, 1) >> U(32)).astype(np.uint32), "text": text, "lo": place}
                texts, rows = unify({c: own[c].to_numpy() for c in TEXTS}, rows)
                rows, done, firsts = settle(rows, mode)
                found = replies(texts, rows, done=done)
                if len(found):
                    yield found.assign(owner=-1, texts=b"", rows=b"")
                out = pd.DataFrame(deal(texts, {c: rows[c][firsts] for c in OPEN}, rows["a"][firsts], OPEN, owners))
                if len(out):
                    yield out.assign(t=0, u=0, id=0, **NO_REPLY)

        return run

    def _own_windows(self, frame: pd.DataFrame, length: int) -> pd.DataFrame:
        texts, rows = gather(frame, OPEN)
        rows, done, _ = settle(rows, self.mode if length == self.window else "all")
        return replies(texts, rows, done=done)


def _spots(own: pd.DataFrame) -> np.ndarray:
    """text << 40 | place of the surviving anchors of a batch, in order."""
    spots = [pairs_of(x)[:, 0] for x in own["spots"]]
    return np.unique((np.repeat(np.arange(len(own)), [len(x) for x in spots]) << 40) | np.concatenate(spots))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, u, id, text: the text as bytes and its key; a null id orders last, a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"), F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("id"), text.cast("binary").alias("text"))


def by_text(found: DataFrame) -> DataFrame:
    """Collects the replies about each text; a few rows an owner and task that have it."""
    full = lambda c: F.filter(F.collect_list(c), lambda x: F.length(x) > 0).alias(c)
    return found.groupBy("t", "u", "id").agg(full("done"), full("open"), full("crowded"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """t, u, id (the smallest), text, copies: each text once. Tasks collapse copies before they are dealt."""
    return rows.groupBy("t", "u").agg(F.min("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def finish(rows: DataFrame, texts: DataFrame, covered: DataFrame, each: Callable, columns: str, all_copies: bool = False) -> DataFrame:
    """doc_id and the columns of each row. covered: t, u, done, any number of rows a text. each(text, covered pairs, whole) gives the columns
    of a text; whole says whether all of it repeats an equal text that counts before it: of the rows of a text those with other than
    its smallest id or, with all_copies, all if there are several.

    Texts are finished once each, as a first occurrence and, if there are copies, as a later one; rows then fetch their result without carrying
    their text, so copies of one text never meet with it in one task."""
    done = covered.groupBy("t", "u").agg(F.flatten(F.collect_list("done")).alias("done"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                pairs = pairs_of(r.done)
                out += [(r.t, r.u, r.id, whole, *each(r.text, pairs, whole)) for whole in ((False,) if r.copies == 1 else (True,) if all_copies else (False, True))]
            yield pd.DataFrame(out, columns=["t", "u", "first_id", "whole", *names])

    finished = materialise(texts.join(done, ["t", "u"], "left").select("t", "u", "id", "copies", "text", "done").mapInPandas(run, f"t long, u int, first_id long, whole boolean, {columns}"), "repeats-finished")
    own = rows.select("doc_id", "t", "u", "id").join(finished, ["t", "u"])
    return own if all_copies else own.where(F.col("whole") == (F.col("id") != F.col("first_id")))


def spread(covered: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n items lie in a window that (first, further) pairs name."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, covered[:, 0], 1)
    np.add.at(mark, covered[:, 0] + covered[:, 1] + window, -1)
    return np.cumsum(mark[:-1]) > 0
