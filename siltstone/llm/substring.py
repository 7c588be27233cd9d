"""Substring dedup: words covered by windows that repeat, found by level-wise doubling.

Rounds: runs of 9 words at anchors are compared with all others; only those that occur again are extended to twice that length and
compared in the next round, and what repeats again to the full window of 35 (twice 18, cut to what is asked for), until nothing
survives. See repeats.py for how a round is dealt. Words are compared by 64-bit hashes and windows by 96 bits of those: among n
different windows some two are taken for equal with a chance of n^2 / 2^97 (5e-8 for 10^11).

Words are runs of anything but ASCII white space, unchanged. Windows are judged on the input. Defined cases: null
text has no words; the digest of no kept words is that of the empty string; a text that occurs in several rows
repeats as a whole if it has a window at all; rows that repeat id and text count as copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.repeats import U, Batch, Spans, Windows, distinct_texts, finish, keyed, mixed, spread

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def words(texts: list[bytes]) -> Batch:
    """The hash of each word, and where each text's words begin."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[raw]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    values = Spans(BYTES[raw], two=False).of(begin, end) ^ (end - begin).astype(U)
    places = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return Batch(mixed(values), np.searchsorted(begin, places))


def repeated_words(docs: DataFrame, window: int = 35, first: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. first: the shortest length looked up; window is more than twice that."""
    find = Windows(window, (first, 2 * first), "all", words)
    rows = keyed(docs, id_col, text_col)
    texts = distinct_texts(rows)
    found = find.find(texts)
    opened = found.select("t", "u", F.concat("open", "crowded").alias("ranges")).where("size(ranges) > 0")
    more = find.settle_windows(texts, opened)
    covered = found.select("t", "u", "done").where("size(done) > 0").unionByName(more.select("t", "u", F.array("done").alias("done")))
    def each(raw: bytes, pairs: np.ndarray, whole: bool) -> tuple:
        own = raw.split()
        if whole and len(own) >= window:
            kept = []
        else:
            gone = spread(pairs, len(own), window)
            kept = [w for w, g in zip(own, gone) if not g] if gone.any() else own
        return len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    # of a text that occurs more than once every occurrence repeats
    every = finish(rows, texts, covered, each, "n_words long, n_removed long, kept_sha256 string", all_copies=True)
    return every.select("doc_id", "n_words", "n_removed", "kept_sha256")
