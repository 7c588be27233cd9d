"""A persisted search index: postings by term with block maxima, and vectors in shells around pivots.

Build. Chunks are range-sorted by (chunk_id, ord) and cut into segments of SEGMENT chunks inside the tasks, so a chunk's place (segment,
position) is also its order among equal scores. A task writes, for each segment, a row a term: positions, counts and lengths, with the largest count
and the smallest length, which bound what the term can add to any score there. A word that half of all chunks hold is one row a segment;
nothing gathers a term. Postings are written by bucket of the term and sorted by it, so a query reads the buckets and row groups of its
own words. Vectors are assigned to the nearest of PIVOTS sampled ones, sorted by pivot and angle, and cut into blocks: a
shell between two angles around its pivot.

Search. Queries meet the postings of their words segment by segment. A running best of each query in the task gives the key that a
segment must be able to reach: if the sum of its terms' bounds is below, it is skipped for that query. For vectors, the angle between a
query and a shell is at least the gap between their angles to the pivot; shells that can't reach the best so far are skipped, and the pivots
themselves, scored on the driver, give a first best. What is skipped can't be in the result, so results are those of a full scan. Every
answer leaves as places; ids come from the segments they name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import embed, text
from siltstone.session import removed

SEGMENT = 512
PIVOTS = 256
SHELL = 256
CELLS = 1 << 19  # scores a task holds at once
HELD = 1 << 16  # rows a task holds besides twice its queries' best
STAGED = "kind string, segment long, term string, n int, most int, least int, at binary, tf binary, length binary, ords array<long>, ids array<string>, vector binary"
SLACK = 1e-9
PLACE = 16  # bits of a position in its segment
FEW = 32  # words that are named in the filter of a scan


class Top:
    """The best keys of each query so far, and the rows that may be among its best limits[q]."""

    def __init__(self, limits: np.ndarray, first: np.ndarray | None = None):
        self.limits, self.most = limits, max(1, int(limits.max(initial=1)))
        self.keys = np.full((len(limits), self.most), -np.inf)
        self.floor = np.full(len(limits), -np.inf) if first is None else first.copy()
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = self.seen = self.skipped = 0

    def reachable(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which of the queries q can still gain from something of at most bound."""
        ok = millionths(bound + SLACK) >= self.floor[q]
        self.seen, self.skipped = self.seen + len(ok), self.skipped + int((~ok).sum())
        return ok

    def add(self, q: np.ndarray, scores: np.ndarray, segment: np.ndarray | int, at: np.ndarray, least: float | None) -> None:
        """scores: a row a query of q, a column a chunk; segment, at: of the columns."""
        keys = millionths(scores)
        if least is not None:
            keys[keys <= least] = -np.inf
        both = np.concatenate([self.keys[q], keys], axis=1)
        both = -np.sort(-np.partition(both, both.shape[1] - self.most, axis=1)[:, -self.most :], axis=1)
        self.keys[q] = both
        self.floor[q] = np.maximum(self.floor[q], both[np.arange(len(q)), self.limits[q] - 1])
        row, col = np.nonzero((keys >= self.floor[q][:, None]) & (keys > -np.inf))
        self.rows.append((q[row], np.broadcast_to(segment, scores.shape[1])[col], at[col], scores[row, col], keys[row, col]))
        self.held += len(row)
        if self.held > 2 * int(self.limits.sum()) + HELD:
            self.rows = [self.best()]
            self.held = len(self.rows[0][0])

    def best(self) -> tuple[np.ndarray, ...]:
        """The best limits[q] rows of each query so far: by key, then place. Equal keys (copies) don't add up."""
        columns = [np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0) for i in range(5)]
        q, key = columns[0].astype(np.int64), columns[4]
        ok = np.flatnonzero(key >= self.floor[q])
        order = ok[np.lexsort([columns[2][ok], columns[1][ok], -key[ok], q[ok]])]
        own = q[order]
        nth = np.arange(len(own)) - np.searchsorted(own, own, "left")
        return tuple(c[order[nth < self.limits[own]]] for c in columns)

    def found(self) -> pd.DataFrame:
        told = [np.concatenate([x, [y]]) for x, y in zip(self.best()[:4], (-1, self.seen, self.skipped, 0))]  # q = -1: what was looked at, and skipped
        return pd.DataFrame({"q": told[0].astype(np.int64), "segment": told[1].astype(np.int64), "at": told[2].astype(np.int64), "score": told[3].astype(float)})


class Exact:
    """The scores of given places: places[q] of query q."""

    def __init__(self, places: list[np.ndarray]):
        self.q = np.repeat(np.arange(len(places)), [len(p) for p in places])
        flat = np.concatenate([*places, np.zeros(0, np.int64)])
        order = np.lexsort([self.q, flat])
        self.q, self.place, self.rows = self.q[order], flat[order], []

    def reachable(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.ones(len(q), bool)

    def add(self, q: np.ndarray, scores: np.ndarray, segment: np.ndarray | int, at: np.ndarray, least: float | None) -> None:
        places = (np.asarray(segment, np.int64) << PLACE) + at
        lo, hi = np.searchsorted(self.place, places, "left"), np.searchsorted(self.place, places, "right")
        col = np.flatnonzero(hi > lo)
        n = hi[col] - lo[col]
        to = np.repeat(lo[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.searchsorted(q, self.q[to])
        ok = (row < len(q)) & (q[np.minimum(row, len(q) - 1)] == self.q[to])
        self.rows.append((self.q[to][ok], self.place[to][ok], scores[row[ok], np.repeat(col, n)[ok]]))

    def found(self) -> pd.DataFrame:
        q, place, score = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0) for i in range(3))
        return pd.DataFrame({"q": q.astype(np.int64), "segment": place.astype(np.int64) >> PLACE, "at": place.astype(np.int64) & ((1 << PLACE) - 1), "score": score.astype(float)})


class Ahead:
    """How many chunks come before each of given (key, place) of a query, in order of key (largest first) and place: counts of chunks between them.
    A row is (q, nth, n): n chunks before the nth, and not before the one ahead of it."""

    def __init__(self, given: list[tuple[np.ndarray, np.ndarray]]):
        """given[q]: keys and places, in that order."""
        self.first = np.concatenate([[0], np.cumsum([len(k) + 1 for k, _ in given])])
        self.start = np.concatenate([[0], np.cumsum([len(k) for k, _ in given])])
        self.code = np.concatenate([*(self._code(i, k) for i, (k, _) in enumerate(given)), np.zeros(0, np.int64)])
        self.place = np.concatenate([*(p for _, p in given), np.zeros(0, np.int64)])
        self.counts = np.zeros(self.first[-1], np.int64)

    reachable = Exact.reachable

    @staticmethod
    def _code(q: np.ndarray | int, keys: np.ndarray) -> np.ndarray:
        return (np.asarray(q, np.int64) << 40) + (1 << 39) - keys.astype(np.int64)

    def add(self, q: np.ndarray, scores: np.ndarray, segment: np.ndarray | int, at: np.ndarray, least: float | None) -> None:
        keys = millionths(scores)
        keep = np.ones(keys.shape, bool) if least is None else keys > least
        row, col = np.nonzero(keep)
        owner, code = q[row], self._code(q[row], keys[row, col])
        places = (np.broadcast_to(np.asarray(segment, np.int64), scores.shape[1])[col] << PLACE) + at[col]
        to, right = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        tie = np.flatnonzero(right > to)
        if len(tie):  # equal keys go by place; a chunk isn't before itself
            merged = np.lexsort([np.repeat([0, 1], [len(self.code), len(tie)]), np.concatenate([self.place, places[tie]]), np.concatenate([self.code, code[tie]])])
            before = np.cumsum(merged < len(self.code))
            mine = merged >= len(self.code)
            to[tie[merged[mine] - len(self.code)]] = before[mine]
        np.add.at(self.counts, self.first[owner] + to - self.start[owner], 1)

    def found(self) -> pd.DataFrame:
        at = np.flatnonzero(self.counts)
        q = np.searchsorted(self.first, at, "right") - 1
        return pd.DataFrame({"q": q, "segment": at - self.first[q], "at": self.counts[at], "score": 0.0}).astype({"q": "int64", "segment": "int64", "at": "int64"})


FOUND = "q long, segment long, at long, score double"


def millionths(scores: np.ndarray) -> np.ndarray:
    return np.floor(np.abs(scores) * 1e6 + 0.5) * np.sign(scores)


# --- build


def _stage(size: int, kind: str | None, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a task's chunks: a row of ids, a row a term, a row a vector."""
    base, held, nth = TaskContext.get().partitionId() << 32, [], 0

    def segment() -> pd.DataFrame:
        own = pd.concat(held, ignore_index=True)
        found = [embed.TOKEN.findall((c or "").encode().lower()) for c in own["content"]]
        lengths = np.array([len(t) for t in found], "<u4")
        counts = [] if kind is None else [embed.counted(t) for t in found] if "counts" not in own.columns else own["counts"]
        names: dict[bytes, int] = {}
        flat = np.fromiter((names.setdefault(t, len(names)) for doc in found for t in doc), np.int64, int(lengths.sum()))
        cells, tf = np.unique(flat * len(own) + np.repeat(np.arange(len(own)), lengths), return_counts=True)
        term, at, tf = cells // len(own), (cells % len(own)).astype("<u2"), tf.astype("<u4")
        cuts = np.searchsorted(term, np.arange(len(names) + 1))
        rows = [("ids", None, len(own), None, None, None, None, lengths.tobytes(), own["ord"].tolist(), own["chunk_id"].tolist(), None)]
        for i, name in enumerate(names):
            lo, hi = cuts[i], cuts[i + 1]
            rows.append(("term", name.decode(), hi - lo, int(tf[lo:hi].max()), int(lengths[at[lo:hi]].min()), at[lo:hi].tobytes(), tf[lo:hi].tobytes(), lengths[at[lo:hi]].tobytes(), None, None, None))
        rows += [("vector", None, i, None, None, None, None, None, None, None, np.asarray(v, kind).tobytes()) for i, v in enumerate(counts)]
        out = pd.DataFrame(rows, columns=["kind", "term", "n", "most", "least", "at", "tf", "length", "ords", "ids", "vector"])
        out.insert(1, "segment", base + nth)
        return out.astype({c: "Int32" for c in ("n", "most", "least")})

    for frame in frames:
        while len(frame):
            room = size - sum(map(len, held))
            held.append(frame[:room])
            frame = frame[room:]
            if sum(map(len, held)) == size:
                yield segment()
                held.clear()
                nth += 1
    if held:
        yield segment()


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _matrix(raw: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)


def _assign(pivots: np.ndarray, kind: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nearest pivot of each vector and the angle to it; -1 for vectors of no length."""
    units = _unit(pivots)
    for frame in frames:
        if len(frame):
            own = _matrix(frame["vector"], kind)
            near = _unit(own) @ units.T
            pivot = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), pivot], -1, 1))
            empty = ~own.any(1)
            yield frame.assign(pivot=np.where(empty, -1, pivot), angle=np.where(empty, 0.0, angle))


def _shells(size: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of consecutive vectors of one pivot."""
    held: pd.DataFrame | None = None

    def cut(rows: pd.DataFrame, last: bool) -> tuple[list[tuple], pd.DataFrame]:
        out, pivot = [], rows["pivot"].to_numpy()
        lo = 0
        while lo < len(rows):
            hi = min(lo + size, lo + int(np.searchsorted(pivot[lo:], pivot[lo], "right")))
            if hi == len(rows) and not last and hi - lo < size:
                break
            own = rows[lo:hi]
            out.append((int(pivot[lo]), float(own["angle"].min()), float(own["angle"].max()), own["segment"].to_numpy("<i8").tobytes(), own["n"].to_numpy("<i4").tobytes(), b"".join(own["vector"])))
            lo = hi
        return out, rows[lo:]

    for frame in frames:
        if len(frame):
            out, held = cut(frame if held is None else pd.concat([held, frame], ignore_index=True), False)
            yield pd.DataFrame(out, columns=BLOCK_NAMES)
    if held is not None and len(held):
        yield pd.DataFrame(cut(held.reset_index(drop=True), True)[0], columns=BLOCK_NAMES)


BLOCK_NAMES = ["pivot", "low", "high", "segments", "places", "vectors"]
BLOCKS = "pivot int, low double, high double, segments binary, places binary, vectors binary"


TABLES = {
    "postings": "term string, segment long, n int, most int, least int, at binary, tf binary, length binary, bucket int",
    "terms": "term string, df long, bucket int",
    "segments": "segment long, n long, ords array<long>, ids array<string>, length binary",
    "vectors": BLOCKS,
    "totals": "n long, tokens long, buckets int, kind string",
    "pivots": "pivot int, segment long, n int, vector binary",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def _parts(df: DataFrame, target: int = 64 << 20) -> int:
    """Partitions of about target bytes by Catalyst's estimate, never fewer than the session's own, which are taken where it knows no size."""
    own, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return own if size >= 1 << 60 else max(own, -(-size // target))


def build(corpus: DataFrame, path: str, segment: int = SEGMENT, buckets: int | None = None, pivots: int = PIVOTS, shell: int = SHELL, vectors: bool = True) -> Index:
    """Writes the index of a corpus (ord, chunk_id, content, and counts if it is embedded already) below path; without vectors it has words alone."""
    spark = corpus.sparkSession
    kind = "<f8" if "counts" in corpus.columns else "<f4"  # hashed counts are whole numbers, which floats hold
    n = min(_parts(corpus), 1 << 15)  # partitions and positions share a place's bits
    ordered = corpus.select("ord", "chunk_id", "content", *["counts"] * ("counts" in corpus.columns)).repartitionByRange(n, "chunk_id", "ord").sortWithinPartitions("chunk_id", "ord")
    ordered.mapInPandas(partial(_stage, segment, kind if vectors else None), STAGED).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/staged")
    staged = spark.read.schema(STAGED).parquet(f"{path}/staged")
    buckets = buckets or max(64, min(4096, _parts(staged, 256 << 20)))
    terms = staged.where("kind = 'term'").select("term", "segment", "n", "most", "least", "at", "tf", "length", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    terms.repartitionByRange(_parts(terms), "bucket", "term", "segment").sortWithinPartitions("bucket", "term", "segment").write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{path}/postings")
    postings = _table(spark, path, "postings")
    df = postings.groupBy("bucket", "term").agg(F.sum("n").cast("long").alias("df"))
    df.repartitionByRange(n, "bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    ids = staged.where("kind = 'ids'").select("segment", F.col("n").cast("long").alias("n"), "ords", "ids", "length")
    ids.sortWithinPartitions("segment").write.mode("overwrite").parquet(f"{path}/segments")
    found = staged.where("kind = 'vector'").select("segment", "n", "vector")
    zero = F.hex("vector").rlike("^0*$")
    sample = [] if not vectors else found.where(~zero).orderBy(F.xxhash64("segment", "n")).limit(pivots).collect()  # a bounded sample, all vectors are indexed
    chosen = _matrix(pd.Series([r["vector"] for r in sample]), kind) if sample else np.zeros((0, embed.DIM))
    assigned = found.mapInPandas(partial(_assign, chosen if len(chosen) else np.zeros((1, embed.DIM)), kind), "segment long, n int, vector binary, pivot int, angle double")
    if vectors:
        assigned.repartitionByRange(n, "pivot", "angle").sortWithinPartitions("pivot", "angle", "segment", "n").mapInPandas(partial(_shells, shell), BLOCKS).write.mode("overwrite").parquet(f"{path}/vectors")
    sums = _table(spark, path, "segments").select("n", "length").mapInPandas(_lengths, "n long, tokens long").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    spark.createDataFrame([(i, r["segment"], r["n"], bytes(r["vector"])) for i, r in enumerate(sample)], "pivot int, segment long, n int, vector binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    removed(spark, f"{path}/staged")
    return Index(spark, path, vectors)


def _lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"n": frame["n"], "tokens": [int(np.frombuffer(x, "<u4").sum()) for x in frame["length"]]})


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(tf=[int(np.frombuffer(x, "<u4").sum()) for x in frame["tf"]])


def _token_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame[["segment", "ords", "ids"]].assign(sizes=[np.frombuffer(x, "<u4").astype(np.int64) for x in frame["length"]])


# --- search


class Index:
    """An index below path. Ranked lists are those of a full scan: see retrieval.bm25_ranked and vector_ranked."""

    def __init__(self, spark: SparkSession, path: str, vectors: bool = True):
        self.spark, self.path = spark, path
        read = partial(_table, spark, path)
        self.postings, self.terms, self.segments = read("postings"), read("terms"), read("segments")
        self.vectors = read("vectors") if vectors else None
        totals = read("totals").first()
        self.docs, self.tokens, self.buckets, self.kind = totals["n"], totals["tokens"], totals["buckets"], totals["kind"]
        self.pivots = read("pivots").orderBy("pivot").collect()

    def _of_words(self, table: DataFrame, words: list[str]) -> DataFrame:
        """Rows of these words. A few reach the files as a filter; many (of a block of queries, so a bounded number) are broadcast."""
        asked = self.spark.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("term")).select("term", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket"))
        if len(words) > FEW:
            return table.join(F.broadcast(asked), ["bucket", "term"], "left_semi")
        return table.where(F.col("bucket").isin([r["bucket"] for r in asked.select("bucket").distinct().collect()]) & F.col("term").isin(words))

    def bm25(self, asked: list[tuple[object, int, list[str]]], visit: Exact | Ahead | None = None) -> DataFrame:
        """q, segment, at, score of what may be among the best; asked: (name, limit, words) of each query, q counts them. visit: what looks at the scores instead."""
        words = sorted({w for _, _, own in asked for w in own})
        df = dict(map(tuple, self._of_words(self.terms, words).select("term", "df").collect())) if words else {}
        words = sorted(df)
        at = {w: i for i, w in enumerate(words)}
        weight = np.array([np.log(1.0 + (self.docs - df[w] + 0.5) / (df[w] + 0.5)) for w in words])
        wanted = [np.array(sorted(at[w] for w in set(own) if w in at), np.int64) for _, _, own in asked]
        limits, mean = np.array([n for _, n, _ in asked], np.int64), self.tokens / self.docs if self.tokens else 1.0
        if not words:
            return self.spark.createDataFrame([], FOUND)
        own = self._of_words(self.postings, words).select("segment", "term", "most", "least", "at", "tf", "length")
        return own.repartition("segment").sortWithinPartitions("segment", "term").mapInPandas(partial(_score, at, weight, wanted, visit or Top(limits), mean), FOUND)

    def near(self, asked: list[tuple[object, int, np.ndarray]], hashed: bool = True, visit: Exact | Ahead | None = None) -> DataFrame:
        """The same for vectors: (name, limit, vector)."""
        limits = np.array([n for _, n, _ in asked], np.int64)
        wanted = np.array([v for _, _, v in asked], float).reshape(len(asked), -1)
        if not len(asked):
            return self.spark.createDataFrame([], FOUND)
        if self.vectors is None:
            raise ValueError(f"{self.path}: an index of words alone has no vectors")
        pivots = _matrix(pd.Series([r["vector"] for r in self.pivots]), self.kind) if self.pivots else np.zeros((0, wanted.shape[1]))
        first = -np.sort(-millionths(cosines(wanted, pivots, hashed)), axis=1)
        floor = np.array([row[n - 1] if n <= len(row) else -np.inf for row, n in zip(first, limits)])
        return self.vectors.mapInPandas(partial(_close, wanted, pivots, visit or Top(limits, floor), hashed, self.kind), FOUND)

    def term_totals(self) -> DataFrame:
        """term, df, tf, most, least of all postings."""
        sums = self.postings.select("term", "n", "tf", "most", "least").mapInPandas(_counts, "term string, n long, tf long, most int, least int")
        return sums.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tf").alias("tf"), F.max("most").alias("most"), F.min("least").alias("least"))

    def places(self) -> DataFrame:
        """ord, chunk_id, n_tokens, place: segments count on from those before them (a row a segment)."""
        before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        starts = self.segments.select("segment", "n").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("segment", "start")
        rows = self.segments.mapInPandas(_token_counts, "segment long, ords array<long>, ids array<string>, sizes array<long>").join(starts, "segment")
        each = rows.select("start", F.posexplode(F.arrays_zip("ords", "ids", "sizes")).alias("at", "x"))
        return each.select(F.col("x.ords").alias("ord"), F.col("x.ids").alias("chunk_id"), F.col("x.sizes").alias("n_tokens"), (F.col("start") + F.col("at")).alias("place"))

    @staticmethod
    def skipped(found: DataFrame) -> DataFrame:
        """seen, skipped: pairs of a query and a segment (or shell) that a search came across, and those that its bounds left out."""
        return found.where("q = -1").agg(F.sum("segment").alias("seen"), F.sum("at").alias("skipped"))

    def lists(self, found: DataFrame, n: int, queries: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and places of the n best of each query, on the driver."""
        order = Window.partitionBy("q").orderBy(text.score_key(F.col("score")).desc(), "segment", "at")
        rows = found.where("q >= 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).toPandas().sort_values(["q", "nth"])
        cuts = np.searchsorted(rows["q"].to_numpy(), np.arange(queries + 1))
        place = (rows["segment"].to_numpy(np.int64) << PLACE) + rows["at"].to_numpy(np.int64)
        return [(rows["score"].to_numpy(float)[lo:hi], place[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]

    def standing(self, search: Callable[..., DataFrame], asked: list[tuple], places: list[np.ndarray], least: float | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Score and rank (from 0, -1 for none) of given places in the whole ranked list of each query: one scan for scores, one that counts what comes before."""
        got = search(asked, visit=Exact(places)).toPandas()
        at = (got["segment"].to_numpy(np.int64) << PLACE) + got["at"].to_numpy(np.int64)
        score, q = got["score"].to_numpy(float), got["q"].to_numpy(np.int64)
        out, given = [], []
        for i, own in enumerate(places):
            mine = np.zeros(len(own))
            order = np.argsort(own)
            to = order[np.searchsorted(own[order], at[q == i])]
            mine[to] = score[q == i]
            keys = millionths(mine)
            listed = np.flatnonzero(keys > least) if least is not None else np.arange(len(own))
            listed = listed[np.lexsort([own[listed], -keys[listed]])]
            given.append((keys[listed], own[listed]))
            out.append((mine, np.full(len(own), -1), listed))
        ahead = search(asked, visit=Ahead(given)).where("q >= 0").groupBy("q", "segment").agg(F.sum("at").alias("n")).toPandas()  # a number a place at most
        for (_, rank, listed), i in zip(out, range(len(out))):
            own = ahead[ahead["q"] == i]
            counts = np.zeros(len(listed) + 1, np.int64)
            counts[own["segment"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
            rank[listed] = np.cumsum(counts)[:-1]
        return [(score_, rank) for score_, rank, _ in out]

    def ranked(self, found: DataFrame, asked: list[tuple], score: str, rank: str) -> DataFrame:
        """q_id, ord, chunk_id, score and rank from 0 of the best of each query."""
        kind = "long" if isinstance(asked[0][0], int) else "string"
        names = self.spark.createDataFrame([(i, a[0], int(a[1])) for i, a in enumerate(asked)], f"q long, q_id {kind}, n long")
        order = Window.partitionBy("q").orderBy(text.score_key(F.col("score")).desc(), "segment", "at")
        best = found.where("q >= 0").withColumn(rank, F.row_number().over(order) - 1).join(F.broadcast(names), "q").where(F.col(rank) < F.col("n"))
        ids = best.join(self.segments.select("segment", "ords", "ids"), "segment")
        at = lambda c: F.element_at(c, (F.col("at") + 1).cast("int"))
        return ids.select("q_id", at("ords").alias("ord"), at("ids").alias("chunk_id"), F.col("score").alias(score), rank)


def cosines(a: np.ndarray, b: np.ndarray, hashed: bool) -> np.ndarray:
    scores = a @ b.T
    if not hashed:
        return scores
    both = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return np.divide(scores, both, out=np.zeros_like(scores), where=both > 0)


def _close(wanted: np.ndarray, pivots: np.ndarray, top: Top | Exact | Ahead, hashed: bool, kind: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hashed: by cosine; else by dot product, which is bounded through the longest vector of a block."""
    away = np.arccos(np.clip(_unit(wanted) @ _unit(pivots).T, -1, 1))
    sizes = np.sqrt((wanted * wanted).sum(1))
    step = max(1, CELLS // max(1, len(wanted)))
    for frame in frames:
        if not len(frame):
            continue
        pivot, low, high = (frame[c].to_numpy() for c in ("pivot", "low", "high"))
        gap = np.maximum(np.maximum(low - away[:, pivot], away[:, pivot] - high), 0) if len(pivots) else np.zeros((len(wanted), len(frame)))
        bound = np.where(pivot < 0, 0.0, np.cos(gap))
        for i in np.argsort(-bound.sum(0), kind="stable"):  # what is near many queries first
            own = np.frombuffer(frame["vectors"].iloc[i], kind).astype(float).reshape(-1, wanted.shape[1])
            most = bound[:, i] if hashed else np.where(bound[:, i] > 0, bound[:, i] * np.sqrt((own * own).sum(1)).max(), 0) * sizes
            q = np.flatnonzero(top.reachable(np.arange(len(wanted)), most))
            segment, at = np.frombuffer(frame["segments"].iloc[i], "<i8"), np.frombuffer(frame["places"].iloc[i], "<i4").astype(np.int64)
            for lo in range(0, len(own) if len(q) else 0, step):
                top.add(q, cosines(wanted[q], own[lo : lo + step], hashed), segment[lo : lo + step], at[lo : lo + step], None)
    yield top.found()


def _score(terms: dict[str, int], weight: np.ndarray, wanted: list[np.ndarray], top: Top | Exact | Ahead, mean: float, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores segments of postings; frames are sorted by segment and term."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in wanted])])
    flat = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(wanted)), np.diff(first))
    gain = lambda tf, length: tf * (text.K1 + 1) / (tf + text.K1 * (1 - text.B + text.B * (length / mean)))
    for segment, own in whole(frames):
        term = np.array([terms[t] for t in own["term"]], np.int64)
        row = np.full(len(weight), -1)
        row[term] = np.arange(len(term))
        most = weight[term] * gain(own["most"].to_numpy(float), own["least"].to_numpy(float))
        mine = row[flat]
        has = mine >= 0
        bound = np.bincount(owner[has], most[mine[has]], len(wanted))
        asks = np.flatnonzero(bound > 0)
        asks = asks[top.reachable(asks, bound[asks])]
        if not len(asks):
            continue
        at = np.frombuffer(b"".join(own["at"]), "<u2").astype(np.int64)
        size = np.array([len(x) // 2 for x in own["at"]])
        start = np.cumsum(size) - size
        part = np.repeat(weight[term], size) * gain(np.frombuffer(b"".join(own["tf"]), "<u4").astype(float), np.frombuffer(b"".join(own["length"]), "<u4").astype(float))
        width = int(at.max()) + 1
        for lo in range(0, len(asks), step := max(1, CELLS // width)):
            q = asks[lo : lo + step]
            rows = [mine[first[i] : first[i + 1]] for i in q]
            rows = [r[r >= 0] for r in rows]
            nth, r = np.repeat(np.arange(len(q)), [len(x) for x in rows]), np.concatenate(rows)
            scores = np.zeros(len(q) * width)
            for b in range(0, len(r), 4096):  # a bounded number of postings at a time
                many = size[r[b : b + 4096]]
                to = np.repeat(start[r[b : b + 4096]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                np.add.at(scores, np.repeat(nth[b : b + 4096], many) * width + at[to], part[to])
            top.add(q, scores.reshape(len(q), width), segment, np.arange(width), 0)
    yield top.found()


def whole(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each segment."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        segment = frame["segment"].to_numpy()
        cuts = np.flatnonzero(segment[1:] != segment[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(frame)]):
            if lo == hi:
                continue
            if held and held[0]["segment"].iloc[0] != segment[lo]:
                yield held[0]["segment"].iloc[0], pd.concat(held, ignore_index=True)
                held = []
            held.append(frame[lo:hi])
    if held:
        yield held[0]["segment"].iloc[0], pd.concat(held, ignore_index=True)
