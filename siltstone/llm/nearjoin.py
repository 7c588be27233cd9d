"""MinHash near-dedup: a chosen-path set similarity join with exact confirmation.

A document's set is its distinct shingles of 3 words (A-Z lower-cased). Equal sets are one node of the join, named by a
hash of the set. Every set has COORDINATES MinHash values. A tree of the join starts with all sets in its root; a tree
node picks the coordinate its name leads to (and, for a share 1 / threshold - 1 of the nodes, a second one, so that the
expected number of paths a pair at the threshold stays on together does not fall with depth), and its sets go on to the child
named by their value there.

Nodes at depth STEP of up to LEAF sets are compared exhaustively, by the share of coordinates that agree, with a margin of MARGIN standard
deviations; a leaf gives a spanning forest of what agrees. In a larger node, sets near its pivot (its smallest name) all join the
pivot's family, and sets far from it branch on; as distances of signatures are a metric, a pair that agrees is in one of the two
together. What is still far from the pivot of a large node after LEVELS levels joins it as well. Families are the components of these
pairs; a family holds all links of its sets, and families.py finds them exactly on the full sets, branching again where a family is
large. Rows are in proportion to the sets at every step: a pair that is refused is never a row.

A pair at the threshold is missed if it meets in no tree: computed as 5e-9 (J = 0.85, threshold 0.85) and 6e-8 (0.80), or, if both
sets are far from the pivots of large nodes only, at most 9e-6 and 5e-5 at the second level; the margin adds 1e-6. More similar pairs are missed less.

Defined cases: null text and text without words have the empty set, which links with nothing; fewer than 3 words are one
shingle; rows that repeat an id take part each by itself; null ids order last, and a component of such rows only has a
null component_id and keeps them all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import crowd, forget, fresh, materialise, meet, parts
from siltstone.llm.components import components
from siltstone.llm.families import ITEM, family_links, forest
from siltstone.llm.repeats import BATCH_BYTES, LAST, U, Batch, mixed
from siltstone.llm.substring import words

COORDINATES = 128
TREES = 20
STEP = 3  # depth of a level
LEVELS = 2
LEAF = 256
MARGIN = 5  # standard deviations of the agreement of a pair at the threshold
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_draw = np.random.default_rng(11)
FACTORS, SHIFTS = (_draw.integers(0, 2**64, COORDINATES // 2, dtype=U) | U(1) for _ in range(2))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    batch: Batch = words([FOLD[np.frombuffer(t, np.uint8)].tobytes() for t in texts])
    runs = batch.spans.all(size) if len(batch.values) >= size else np.zeros(0, U)
    out = []
    for lo, hi in zip(batch.starts[:-1], batch.starts[1:]):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        else:
            out.append(batch.spans.of(np.array([lo]), np.array([hi])) ^ U(hi - lo) if hi > lo else np.zeros(0, U))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 16 bits of each; both halves of a product are hashes."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(own), 1024):
        x = own[at : at + 1024, None] * FACTORS
        x ^= x >> U(31)
        x *= SHIFTS
        x ^= x >> U(32)
        np.minimum(low, x.view(np.uint32).min(axis=0), out=low)
    return (mixed(low.astype(U)) >> U(48)).astype("<u2")


def named(own: np.ndarray) -> int:
    """The name of a set, 0 if it is empty."""
    return int(np.bitwise_xor.reduce(mixed(own))) ^ len(own) if len(own) else 0


def agree(threshold: float) -> int:
    """Coordinates on which a pair must agree to be looked at."""
    return int(COORDINATES * threshold - MARGIN * (COORDINATES * threshold * (1 - threshold)) ** 0.5)


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield from (own for _, own in frame.groupby(np.cumsum(frame["text"].map(len).to_numpy()) // BATCH_BYTES))


def _sketch(size: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches(frames):
        sets = shingle_sets(list(own["text"]), size)
        name = [named(s) for s in sets]
        yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "id": own["id"], "text_key": own["text_key"], "n_shingles": [len(s) for s in sets], "node": np.array(name, U).view(np.int64), "signature": [signature(s).tobytes() if len(s) else b"" for s in sets]})


def branch(names: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: row of each path, name of its child."""
    rows = np.arange(len(names))
    for _ in range(STEP):
        drawn = mixed(names + U(0x9E3779B97F4A7C15))
        again = (drawn >> U(40)).astype(np.float64) / 2**24 < 1 / threshold - 1
        first = (drawn % U(COORDINATES)).astype(np.int64)
        second = (first + 1 + ((drawn >> U(8)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        rows, names, at = np.concatenate([rows, rows[again]]), np.concatenate([names, names[again]]), np.concatenate([first, second[again]])
        names = mixed(names ^ (signatures[rows, at].astype(U) << U(8)) ^ (at.astype(U) + U(1)))
    return rows, names


def _signatures(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u2").reshape(-1, COORDINATES)


def _plant(threshold: float, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The paths of each set in every tree, at the first level."""
    roots = mixed(np.arange(1, TREES + 1, dtype=U))
    for frame in frames:
        for at in range(0, len(frame), 4096):
            own = frame[at : at + 4096]
            rows, names = branch(np.repeat(roots, len(own)), np.tile(_signatures(own["signature"]), (TREES, 1)), threshold)
            yield pd.DataFrame({"path": names.view(np.int64), "node": own["node"].to_numpy()[rows % len(own)]})


def _grow(threshold: float, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            rows, names = branch(frame["path"].to_numpy().view(U), _signatures(frame["signature"]), threshold)
            yield pd.DataFrame({"path": names.view(np.int64), "node": frame["node"].to_numpy()[rows]})


def _near(own: pd.DataFrame, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a leaf that agree."""
    node, first = np.unique(own["node"].to_numpy(), return_index=True)
    keys = _signatures(own["signature"])[first]
    return [(node[i], node[j]) for i, j in forest(lambda i, others: (keys[others] == keys[i]).sum(1) >= least, len(node))]


def _leaves(least: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares leaves exhaustively. Rows of a leaf are consecutive; those of two sets, which most are, go together."""
    out = []
    for frame in _whole(frames):
        path = frame["path"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(path)]]))
        node, twos = frame["node"].to_numpy(), starts[counts == 2]
        if len(twos):
            keys = _signatures(frame["signature"])
            twos = np.concatenate([twos[at : at + 4096][(keys[twos[at : at + 4096]] == keys[twos[at : at + 4096] + 1]).sum(1) >= least] for at in range(0, len(twos), 4096)])
            out.append(np.column_stack([node[twos], node[twos + 1]]))
        more = [pair for lo, n in zip(starts[counts > 2], counts[counts > 2]) for pair in _near(frame[lo : lo + n], least)]
        if more:
            out.append(np.array(more, np.int64))
        if sum(map(len, out)) > 100_000:
            yield _pairs(out)
            out = []
    yield _pairs(out)


def _pairs(found: list[np.ndarray]) -> pd.DataFrame:
    pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
    return pd.DataFrame(pairs, columns=["a", "b"])


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that end where a path does."""
    held = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        path = frame["path"].to_numpy()
        cut = len(path) - int((path[::-1] != path[-1]).argmax()) if path[0] != path[-1] else 0
        if cut:
            yield frame[:cut].reset_index(drop=True)
        held = frame[cut:].reset_index(drop=True)
    if held is not None:
        yield held


def _apart(far: int, last: bool, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large nodes with their distance to the pivot: near ones join its family, distant ones go on."""
    for frame in frames:
        if len(frame):
            off = (_signatures(frame["signature"]) != _signatures(frame["pivot_signature"])).sum(1)
            yield frame[["path", "node", "pivot"]].assign(joins=(off <= 2 * far) | last, goes=(off > far) & (not last))


def _sets(size: int, percent: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items of a family; a row whose text isn't the node's (an id may have several texts) goes."""
    for own in batches(frames):
        sets = shingle_sets(list(own["text"]), size)
        frame = own[["family", "node"]].assign(t=[2 * percent * len(s) for s in sets], members=[s.tobytes() for s in sets])
        yield frame[np.array([named(s) for s in sets], U).view(np.int64) == own["node"].to_numpy()]


def near_groups(docs: DataFrame, percent: int = 85, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text). Documents are linked if 100 * shared >= percent * united shingles."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    shape = "doc_id long, id long, text_key long, n_shingles long, node long, signature binary"
    sketches = materialise(rows.mapInPandas(partial(_sketch, size), shape), "near-sketches")
    # the text of a node's set is that of its row with the smallest id and text key; an id may have several texts, and a text several rows
    nodes = materialise(sketches.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("id", "text_key", "signature")).alias("m")).select("node", "m.id", "m.text_key", "m.signature"), "near-nodes")
    total = sketches.count()
    row = F.xxhash64("id", "text_key").alias("row")
    heavy = [r["row"] for r in sketches.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd(total, 1 << 12)).collect()]  # rows that repeat id and text
    edges = _links(rows.select(row, "text"), nodes.select("node", row, "signature"), percent, size, heavy, total)
    labels = components(edges)
    least = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = meet(least, least.groupBy("label").agg(F.min("id").alias("component")), "label", total).select("node", "component")
    full, empty = sketches.where("n_shingles > 0"), sketches.where("n_shingles = 0")
    out = meet(full.select("doc_id", "id", "text_key", "n_shingles", "node"), least, "node", total).unionByName(empty.select("doc_id", "id", "text_key", "n_shingles", "node", F.col("id").alias("component")))
    return out.select("doc_id", "n_shingles", F.nullif("component", F.lit(LAST)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"), "text_key")


def keep_first(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: of each group of near copies those with the smallest id. Rows are told apart by
    id and text, so rows that repeat both stay or go together; a null id stays only if all of its group have none."""
    key, id_, same = fresh(docs, "key", "id", "same")
    kept = near_groups(docs, percent, size, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_), F.col("text_key").alias(same)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(kept, keyed[id_col].eqNullSafe(kept[id_]) & (keyed[key] == kept[same]), "left_semi").select(*docs.columns)


def _links(texts: DataFrame, nodes: DataFrame, percent: int, size: int, heavy: list[int], rows: int) -> DataFrame:
    """Links (a, b) between nodes, confirmed on full sets, that give the components of all. texts: row, text; nodes: node, row (the one whose text
    is its), signature; heavy: rows that many of texts share."""
    found = materialise(_candidates(nodes.select("node", "signature"), percent), "near-candidates")
    together = components(found)
    forget(nodes.sparkSession, found)
    named_ = nodes.select("node", "row").join(together.select("node", F.col("label").alias("family")), "node")
    sets = meet(texts, named_, "row", rows, heavy).mapInPandas(partial(_sets, size, percent), ITEM).dropDuplicates(["node"])
    return family_links(sets, percent)


def _candidates(keyed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which the components hold every link: forests of what agrees in leaves, and stars around the pivots of large nodes."""
    threshold = percent / 100
    far = COORDINATES - agree(threshold)
    front = materialise(keyed.mapInPandas(partial(_plant, threshold), "path long, node long"), "near-paths")
    found = None
    for level in range(LEVELS):
        many = front.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
        held = materialise(meet(front, many, "path", front.count()).join(keyed, "node"), "near-leaves", "lz4")
        leaves_ = held.where(F.col("n") <= LEAF).select("path", "node", "signature").repartition(parts(held), "path").sortWithinPartitions("path")
        pairs = leaves_.mapInPandas(partial(_leaves, COORDINATES - far), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        large = held.where((F.col("n") > LEAF))
        if large.isEmpty():
            break
        pivots = large.where("node = pivot").select("path", F.col("signature").alias("pivot_signature")).dropDuplicates(["path"])
        told = materialise(meet(large.drop("n"), pivots, "path", large.count()).mapInPandas(partial(_apart, far, level == LEVELS - 1), "path long, node long, pivot long, joins boolean, goes boolean"), "near-large", "lz4")
        found = found.unionByName(told.where("joins and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
        front = materialise(told.where("goes").select("path", "node").join(keyed, "node").mapInPandas(partial(_grow, threshold), "path long, node long").distinct(), "near-paths")
    return found
