"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded (fixed byte classes and hashed signs, EMBED numbers a byte). Learned filters read
chunks of WINDOW bytes at every STRIDE bytes, so chunks overlap and cover the whole document; their responses pass a
rectifier and are pooled over all chunks, by maximum and by mean. A logistic layer combines the pooled values into one
probability. Training is Adam on the log loss over labelled rows: those whose crc32(id as text) mod `folds` is not
`held_out`, at most `sample` of them and `sample_bytes` of text, taken in order of a hash of the id. Labels, language, source and id are
never inputs.

Defined cases: null and empty texts are scored as one chunk of zeros; labels that are null are left out, several of
one id count as their maximum; without labelled rows, or with one class only, the score is the smoothed share of
label 1 for every text; rows that repeat an id are scored each by itself; a null id is in no fold (held_out false) and
never trains; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import steady

WINDOW, STRIDE, EMBED, FILTERS = 16, 4, 8, 24
STEPS = WINDOW // STRIDE
PIECE = 1 << 18  # bytes that are in work at once


def byte_table() -> np.ndarray:
    """The embedding of each byte: classes of ASCII, and signs drawn once."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    space, high = np.isin(b, (32, 9, 10, 11, 12, 13)), b >= 128
    other = ~(upper | lower | digit | space | high)
    signs = np.random.default_rng(7).choice([-0.5, 0.5], (256, EMBED - 6))
    table = np.column_stack([upper, lower, digit, space, high, other, signs]).astype(np.float32)
    table[0] = 0
    return table


TABLE = byte_table()


@dataclass
class Model:
    filters: np.ndarray  # (STEPS, STRIDE * EMBED, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # of the maxima, then of the means
    base: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.base, -30, 30)))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, padded with zeros so that no chunk of a text reaches the next: bytes, first chunk of each, chunks of each."""
    counts = np.maximum(1, -(-np.fromiter(map(len, texts), np.int64, len(texts)) // STRIDE))
    firsts = np.concatenate([[0], np.cumsum(counts + STEPS - 1)[:-1]]).astype(np.int64)
    buffer = np.zeros(int((counts + STEPS - 1).sum()) * STRIDE, np.uint8)
    for text, first in zip(texts, firsts):
        buffer[first * STRIDE : first * STRIDE + len(text)] = np.frombuffer(text, np.uint8)
    return buffer, firsts, counts


def responses(model: Model, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded steps and the rectified response of each filter at each chunk."""
    steps = TABLE[buffer].reshape(-1, STRIDE * EMBED)
    n = len(steps) - STEPS + 1
    out = steps[:n] @ model.filters[0]
    for j in range(1, STEPS):
        out += steps[j : j + n] @ model.filters[j]
    out += model.bias
    return steps, np.maximum(out, 0, out=out)


def pool(model: Model, texts: list[bytes]) -> np.ndarray:
    """Maximum and mean of each filter's response over all chunks of each text."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= PIECE):
            held += len(texts[end])
            end += 1
        if len(texts[at]) > PIECE:  # one long text, in pieces that overlap so that each chunk is seen once
            top, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), -(-len(texts[at]) // STRIDE)
            for first in range(0, chunks, PIECE // STRIDE):
                n = min(PIECE // STRIDE, chunks - first)
                raw = texts[at][first * STRIDE : (first + n + STEPS - 1) * STRIDE]
                raw = np.frombuffer(raw + bytes((n + STEPS - 1) * STRIDE - len(raw)), np.uint8)
                _, a = responses(model, raw)
                top, total = np.maximum(top, a.max(0)), total + a.sum(0)
            out[at] = np.concatenate([top, total / chunks])
            end = at + 1
        else:
            buffer, firsts, counts = layout(texts[at:end])
            _, a = responses(model, buffer)
            edges = np.column_stack([firsts, firsts + counts]).ravel()
            edges = edges[:-1] if edges[-1] >= len(a) else edges
            out[at:end, :FILTERS] = np.maximum.reduceat(a, edges, axis=0)[::2]
            out[at:end, FILTERS:] = np.add.reduceat(a, edges, axis=0)[::2] / counts[:, None]
        at = end
    return out


def pieces_of(rows: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """The rows in order, in parts of up to PIECE bytes of text (or one text)."""
    sizes = np.cumsum([len(texts[i]) for i in rows])
    return [part for part in np.split(rows, np.flatnonzero(np.diff(sizes // PIECE)) + 1) if len(part)]


def gradients(model: Model, texts: list[bytes], labels: np.ndarray, n_batch: int) -> list[np.ndarray]:
    """Of the log loss over some texts of a batch: filters, bias, weights, base."""
    buffer, firsts, counts = layout(texts)
    steps, a = responses(model, buffer)
    n = len(a)
    pooled, tops = np.zeros((len(texts), 2 * FILTERS), np.float32), []
    for r, (first, count) in enumerate(zip(firsts, counts)):
        part = a[first : first + count]
        best = part.argmax(0)
        tops.append(first + best)
        pooled[r, :FILTERS], pooled[r, FILTERS:] = part[best, np.arange(FILTERS)], part.mean(0)
    off = (model.score(pooled) - labels).astype(np.float32) / n_batch
    back = off[:, None] * model.weights
    da = np.zeros((n, FILTERS), np.float32)
    for r, (first, count) in enumerate(zip(firsts, counts)):
        da[first : first + count] += back[r, FILTERS:] / count
        da[tops[r], np.arange(FILTERS)] += back[r, :FILTERS]
    da *= a > 0
    return [np.stack([steps[j : j + n].T @ da for j in range(STEPS)]), da.sum(0), pooled.T @ off, np.asarray([off.sum()], np.float32)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 1) -> Model:
    """Fits filters and weights by gradient descent through the pooling."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(rng.normal(0, 0.2, (STEPS, STRIDE * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return model
    model.weights = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
    model.base = 0.0
    values = [model.filters, model.bias, model.weights, np.zeros(1, np.float32)]
    firsts_, seconds_ = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    step = 0
    for _ in range(epochs):
        order = np.concatenate([rng.choice(c, len(labels) // 2) for c in classes])  # both classes weigh the same while filters form
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            model.base = float(values[3][0])
            grads = [np.zeros_like(v) for v in values]
            for part in pieces_of(own, texts):  # gradients add up over parts, which bound what is held at once
                for total, g in zip(grads, gradients(model, [texts[i] for i in part], labels[part], len(own))):
                    total += g
            grads[2] += (1e-4 * model.weights).astype(np.float32)
            step += 1
            for v, g, m, s in zip(values, grads, firsts_, seconds_):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.base = float(values[3][0])
    return model


def fold(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, sample: int = 3000, sample_bytes: int = 64 << 20) -> Model:
    """Trains on at most `sample` labelled rows outside the held-out fold, with at most `sample_bytes` of text together."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    known = known.where(fold(F.col("_id"), folds) != held_out).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").withColumn("_mark", F.xxhash64("_text"))  # known has `sample` rows at most
    sizes = rows.select("_id", "_mark", F.octet_length("_text").alias("n")).orderBy(F.xxhash64("_id"), "_id", "_mark").limit(sample).collect()
    taken, held = [], 0
    for r in sizes:  # texts that would not fit the bytes are passed over
        if held + r["n"] <= sample_bytes:
            taken.append((r["_id"], r["_mark"]))
            held += r["n"]
    wanted = docs.sparkSession.createDataFrame(taken, "_id long, _mark long").distinct()
    found = rows.join(F.broadcast(wanted), ["_id", "_mark"]).dropDuplicates(["_id", "_mark"]).orderBy(F.xxhash64("_id"), "_id", "_mark").collect()
    return train([r["_text"].encode() for r in found], np.asarray([r["_label"] for r in found], np.float64))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns in keep, and the score of each whole text."""
    steady(docs.sparkSession)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(len(keep))]
            scores = model.score(pool(model, texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, name])

    return docs.select(*keep, F.col(text_col).alias("_scored")).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, **options)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, floor: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least floor."""
    steady(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at)]
            if texts:
                yield batch.filter(pa.array(model.score(pool(model, texts)) >= floor))

    return docs.mapInArrow(run, docs.schema)
