"""The persisted index against full scans, and the threshold search against whole ranked lists."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import embed, text
from siltstone.operators import inverted, retrieval

CHUNK = "ord long, chunk_id string, file_path string, start_line long, end_line long, chunk_type string, kind string, language string, content string"
WORDS = [f"w{i}" for i in range(60)]


def chunks(spark, n=401, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        content = rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))), " ".join(rng.choice(WORDS[:5]) for _ in range(6))])
        rows.append((i * 7 % n, f"c{i % 13}" if i % 5 else f"z{i}", "a.py", 1, 1, "m", "m", "t", content))  # ids and scores tie
    return spark.createDataFrame(rows, CHUNK)


def asked(spark, seed=2):
    rng = random.Random(seed)
    own = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))), k) for i, k in enumerate([1, 2, 5, 50, 500, 3, 1, 1])]
    return spark.createDataFrame([*own, (90, "?!", 3), (91, "absent", 4), (92, "w1", 0)], "q_id long, query string, k long")


@pytest.mark.parametrize("segment", [5, 512])
def test_ranked_lists_are_those_of_a_scan(spark, tmp_path, segment):
    c, q = chunks(spark), asked(spark)
    index = inverted.build(c, str(tmp_path), segment=segment, shell=max(3, segment // 4), pivots=segment, buckets=7)
    for ranked, columns in ((retrieval.bm25_ranked, ["q_id", "ord", "chunk_id", "frank", "bm25"]), (retrieval.vector_ranked, ["q_id", "ord", "chunk_id", "vrank", "cosine"])):
        want = sorted(map(tuple, ranked(retrieval.embedded(c), q).select(columns).collect()))
        got = sorted(map(tuple, ranked(None, q, index=index).select(columns).collect()))
        assert [x[:4] for x in got] == [x[:4] for x in want] and all(abs(x[4] - y[4]) < 1e-9 for x, y in zip(got, want))


def test_bounds_skip_what_cannot_be_among_the_best(spark, tmp_path):
    """A rare word's chunks come with a bound that segments of common words can't reach; far shells can't reach a near vector's."""
    rows = [(i, f"c{i:05d}", "a", 1, 1, "m", "m", "t", "rare rare" if i < 3 else "common filler word") for i in range(400)]
    groups = [(i, f"c{i:05d}", "", [1.0, 0.01 * (i % 7)] if i % 2 else [0.01 * (i % 5), 1.0]) for i in range(400)]
    index = inverted.build(spark.createDataFrame(rows, CHUNK), str(tmp_path / "a"), segment=8)
    found = index.bm25([(1, 2, ["rare", "common"])])
    assert index.skipped(found).first()["skipped"] > 0 and found.where("q = 0").count() >= 2
    index = inverted.build(spark.createDataFrame(groups, "ord long, chunk_id string, content string, counts array<double>"), str(tmp_path / "b"), segment=64, shell=16, pivots=4)
    got = index.skipped(index.near([(1, 3, [0.0, 1.0])])).first()
    assert got["skipped"] >= got["seen"] // 3 > 0


def test_a_query_reads_the_buckets_of_its_words(spark, tmp_path):
    index = inverted.build(chunks(spark), str(tmp_path), segment=64)
    plan = index._of_words(index.postings, ["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan


def test_index_of_nothing(spark, tmp_path):
    index = inverted.build(chunks(spark).limit(0), str(tmp_path))
    assert retrieval.bm25_ranked(None, asked(spark), index=index).count() == retrieval.vector_ranked(None, asked(spark), index=index).count() == 0


def test_standing_counts_what_comes_before(spark, tmp_path):
    c = chunks(spark)
    index = inverted.build(c, str(tmp_path), segment=16)
    names = [(i, 401, [f"w{i}", "w3"]) for i in range(4)]
    whole = index.lists(index.bm25(names), 401, 4)
    picked = [places[::3] for _, places in whole]
    for (scores, places), own, (score, rank) in zip(whole, picked, index.standing(index.bm25, names, picked, 0)):
        assert rank.tolist() == list(range(0, len(places), 3)) and abs(score - scores[::3]).max() < 1e-12


def facets(spark, n=1500):
    rng, words = random.Random(5), WORDS[:40]
    rows = [(i, f"c{(i * 37) % n:04d}", f"r{i // 3}" if i % 4 else f"tests/r{i}", 1, 1, "m", "m", "t", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), f"r{i}", f"t w{i % 40}", [], [["x/pull/1"], [], None][i % 3], "wontfix" if i % 9 == 0 else None, str(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, CHUNK + ", record_id string, title string, labels array<string>, links array<string>, state_reason string, updated_at string")


def whole_lists(chunks_, queries, floor=0.3, boost=1.1):
    """search_knowledge over candidates that are the whole corpus."""
    live = retrieval.live(chunks_)
    wide = queries.withColumn("k", F.greatest(F.col("k"), F.lit(live.count())))
    found = retrieval.ranked(retrieval.embedded(live), wide).drop("k").join(queries.select("q_id", "k", text.tokens(F.col("query")).alias("_words")), "q_id")
    own = text.tokens(F.concat_ws(" ", "title", "content"))
    merged = F.exists(F.coalesce("links", F.array().cast("array<string>")), lambda x: x.contains("/pull/"))
    found = found.where((F.col("score") >= floor) & F.arrays_overlap(own, "_words")).withColumn("score", F.when(merged, F.col("score") * boost).otherwise(F.col("score")))
    order = Window.partitionBy("q_id").orderBy(text.score_key(F.col("score")).desc(), F.col("updated_at").desc(), "chunk_id", "ord")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k")


def test_threshold_search_gives_what_whole_lists_give(spark, monkeypatch):
    rng, c = random.Random(6), facets(spark)
    q = spark.createDataFrame([(i, " ".join(rng.choice(WORDS[:40]) for _ in range(rng.randint(1, 5))), k) for i, k in enumerate([1, 2, 5, 50, 3, 1500, 1, 10, 10])] + [(90, "?!", 3), (91, "absent", 4), (92, "w1 absent", 7)], "q_id long, query string, k long")
    depths, own = [], retrieval._at_depth
    monkeypatch.setattr(retrieval, "_at_depth", lambda *a: (depths.append((len(a[3]), a[4])), own(*a))[1])
    shape = lambda df: sorted((r.q_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert shape(retrieval.search_knowledge(c, q)) == shape(whole_lists(c, q))
    assert min(d for _, d in depths) == 128 and max(d for _, d in depths) >= 1500 and sum(n for n, d in depths if d == 128) >= 8
    few = spark.createDataFrame([(1, "w1 w2", 2), (2, "w3 w7 w9", 3)], "q_id long, query string, k long")
    depths.clear()
    assert shape(retrieval.search_knowledge(c, few)) == shape(whole_lists(c, few))
    assert max(d for _, d in depths) < 1000  # these stop before the lists end


def test_recall_by_threshold(spark):
    rows = [(i, f"d{i}", f"{'alpha' if i % 2 else 'beta'} decision number{i}", [], None) for i in range(300)]
    entries = spark.createDataFrame(rows, "ord long, id string, text string, tags array<string>, area string")
    got = retrieval.recall(entries, spark.createDataFrame([("a", "alpha number7", 3)], "q_id string, query string, k long")).orderBy("rank").collect()
    assert got[0].chunk_id == "d7" and len(got) == 3 and all("alpha" in r.content for r in got)


def test_vectors_of_another_embedder(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"c{i}", "", [rng.uniform(-1, 1) for _ in range(9)]) for i in range(200)]
    index = inverted.build(spark.createDataFrame(rows, "ord long, chunk_id string, content string, counts array<double>"), str(tmp_path), segment=32, shell=8, pivots=9)
    want = [r[3] for r in rows[:5]]
    found = index.lists(index.near([(i, 4, v) for i, v in enumerate(want)], hashed=False), 4, 5)
    for v, (scores, _) in zip(want, found):
        dots = sorted((sum(a * b for a, b in zip(v, r[3])) for r in rows), reverse=True)[:4]
        assert max(abs(a - b) for a, b in zip(scores, dots)) < 1e-9


def test_tokens_and_embedding_agree():
    assert (embed.counted(embed.TOKEN.findall(b"alpha beta alpha")) == embed.embed_counts("Alpha BETA alpha")).all()
