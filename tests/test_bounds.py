"""What a task holds stays bounded, whatever the input."""

import tracemalloc

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from siltstone.functions import embed, redact
from siltstone.operators import inverted, retrieval
from siltstone.sources import ndjson


class Scanned:
    """Stands for a corpus: gives the function that a scan runs on frames."""

    def __init__(self, *columns):
        self.columns = columns

    def select(self, *_):
        return self

    def mapInPandas(self, f, _):
        return f


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_holds_few_scores():
    """queries that grow with the vectors don't make a task's scores grow."""
    rng = np.random.default_rng(1)
    own = rng.normal(size=(3000, 8))
    frame = pd.DataFrame({"ord": range(3000), "chunk_id": [f"{i:05d}" for i in range(3000)], "counts": list(own)})
    scan = retrieval.nearest(Scanned("ord", "chunk_id", "counts"), [(i, 2, v) for i, v in enumerate(own[:2000])], hashed=False)
    got, mb = peak(lambda: pd.concat(scan([frame])))
    assert mb < 60
    best = np.argsort(-np.round(own[:2000] @ own.T, 6), axis=1, kind="stable")[:, :2]
    assert got.sort_values(["q_id", "cosine"], ascending=[True, False], kind="stable")["ord"].to_numpy().reshape(-1, 2).tolist() == best.tolist()


def test_relevance_macro_scores_blocks(spark, tmp_path, monkeypatch):
    """the macro's queries come in blocks, and the averages are those of a full comparison."""
    from siltstone import queries

    rng = np.random.default_rng(7)
    own, label = rng.normal(size=(900, 8)).astype(np.float32), rng.integers(0, 3, 900)
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(own, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    asked, near = [], retrieval.nearest
    monkeypatch.setattr(retrieval, "nearest", lambda rows, vectors, **b: asked.append(len(vectors)) or near(rows, vectors, **b))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2, raising=False)
    got = queries.relevance_macro(spark, str(tmp_path)).first()
    at = range(0, 900, 100)
    keys = retrieval.millionths(own[at].astype(np.float64) @ own.T.astype(np.float64))
    met = label[np.argsort(-keys, axis=1, kind="stable")[:, :10]] == label[at][:, None]
    first = np.where(met.any(1), 1.0 / (met.argmax(1) + 1), 0.0)
    assert asked == [2, 2, 2, 2, 1]
    assert got.cases == 9 and abs(got.precision - met.mean()) < 1e-6 and abs(got.mrr - first.mean()) < 1e-6 and abs(got["recall"] - met.any(1).mean()) < 1e-6


def test_best_drops_copies():
    """vectors with equal scores (copies) don't pile up in a task's running best; the first by chunk id, then place, stay."""
    rng = np.random.default_rng(3)
    limits = np.array([10] * 500 + [3])
    best, every, held = retrieval.Best(limits), [], []
    rows = best.rows
    best.rows = lambda: held.append(best.n) or rows()
    for at in range(0, 3000, 500):
        keys = rng.integers(0, 4, (500, 501)).astype(float)
        keys[:, :400] = 7.0
        ids, ords = np.array([f"{i:04d}" for i in rng.integers(0, 900, 500)], dtype=object), rng.permutation(500) + at
        best.add(keys, ids, ords, keys / 10)
        every.append((keys, ids, ords))
    keys, ids, ords = (np.concatenate(x) for x in zip(*every))
    got = best.rows()
    assert max(held) <= 2 * limits.sum() + 20_000 + 10 * len(limits)
    for q, limit in enumerate(limits):
        assert got["ord"][got["q"] == q].tolist() == ords[np.lexsort((ords, ids.astype(str), -keys[:, q]))[:limit]].tolist()


def test_nearest_embeds_where_it_scans():
    texts = ["alpha beta", "beta gamma", "delta"]
    frame = pd.DataFrame({"ord": range(3), "chunk_id": list("abc"), "content": texts})
    got = pd.concat(retrieval.nearest(Scanned("ord", "chunk_id", "content"), [(7, 1, embed.embed_counts("gamma beta"))])([frame]))
    assert got[["q_id", "ord"]].to_numpy().tolist() == [[7, 1]] and abs(got["cosine"].iloc[0] - 1) < 1e-9


def test_top_drops_copies():
    """F2, F9: chunks with equal scores (copies) don't pile up in a task; the first by place stay."""
    top = inverted.Top(np.array([3, 2]))
    for segment in range(400):
        top.add(np.arange(2), np.full((2, 512), 0.5), segment, np.arange(512), None)
    assert top.held < 200_000
    got = top.found()
    assert [got[got["q"] == q][["segment", "at"]].to_numpy().tolist() for q in (0, 1)] == [[[0, 0], [0, 1], [0, 2]], [[0, 0], [0, 1]]]


def test_words_remembered_are_bounded():
    """a worker's cache of terms."""
    embed._cells.clear()
    embed.embed_counts(" ".join(f"w{i}" for i in range(200_000)))
    assert len(embed._cells) <= 1 << 16


def test_lines_are_parsed_once(spark):
    """filters over parsed events don't parse a line again."""
    lines = spark.createDataFrame([(1, '{"event": "search", "ts": "2024-01-01T00:00:00Z", "tokens_saved": 3}'), (2, "{broken"), (3, "[]")], "ord long, value string")
    rows = ndjson.events(lines).where("kind is not null").groupBy("source").agg({"tokens_saved": "sum"})
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") <= 1 and rows.first()[1] == 3


def test_texts_without_keys_stay_out_of_python(spark):
    """F8: and whatever may hold a key, by Python's letter cases and white space, goes there."""
    texts = ["plain", "PassWord　= hunter2hunter2", "ſecret: abcdefghijk", "api_Key\x1c=\x85abcdefghijk", "toKen := x", "auth-token=\"abcdefghijkl\"", "keys are = kept"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", redact.redacted(F.col("t")).alias("r"), F.col("t").rlike(redact.MAY_HOLD).alias("may"))
    assert "_hidden(CASE WHEN RLIKE" in out._jdf.queryExecution().analyzed().toString()
    assert all(r.r == redact.redact_text(r.t) and (r.may or not redact._keys.search(r.t)) for r in out.collect())


def test_words_are_indexed_without_vectors(spark, tmp_path):
    """a search of words builds no vectors."""
    rows = spark.createDataFrame([(i, f"c{i}", f"alpha w{i}") for i in range(5)], "ord long, chunk_id string, content string")
    index, asked = inverted.build(rows, str(tmp_path / "i"), vectors=False), spark.createDataFrame([(0, "w3", 1)], "q_id long, query string, k long")
    assert not (tmp_path / "i" / "vectors").exists()
    assert retrieval.bm25_ranked(None, asked, index=index).first()["chunk_id"] == "c3"
