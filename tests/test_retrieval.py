import math

import pytest

from siltstone.functions import embed
from siltstone.operators import metrics, quality, retrieval


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"c{i}", p, 1, 1, "module", "module", "text", t) for i, (p, t) in enumerate(rows)], "ord long, chunk_id string, file_path string, start_line long, end_line long, chunk_type string, kind string, language string, content string")


def asked(spark, *queries, k=3):
    return spark.createDataFrame([(i, q, k) for i, q in enumerate(queries)], "q_id long, query string, k long")


ROWS = [("a.py", "alpha beta"), ("b.py", "alpha alpha gamma"), ("tests/c.py", "alpha beta"), ("d.py", "delta"), ("e.py", "")]


def test_bm25_by_hand(spark):
    got = {(r.q_id, r.ord): r.bm25 for r in retrieval.bm25_ranked(corpus(spark, ROWS), asked(spark, "beta")).collect()}
    idf, avg = math.log(1 + (5 - 2 + 0.5) / 2.5), 8 / 5
    want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))
    assert set(got) == {(0, 0), (0, 2)} and all(abs(v - want) < 1e-12 for v in got.values())


def test_hybrid_penalises_and_caps(spark):
    got = retrieval.ranked(corpus(spark, ROWS), asked(spark, "beta")).orderBy("rank").collect()
    assert [r.file_path for r in got][:1] == ["a.py"]
    by = {r.file_path: r.score for r in got}
    assert by["tests/c.py"] < by["a.py"]
    same = corpus(spark, [("x.py", f"alpha word{i}") for i in range(9)])
    assert retrieval.ranked(same, asked(spark, "alpha", k=9)).count() == 3


def test_scans_of_several_batches(spark):
    """A task's running best holds ids from more than one Arrow batch."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        c, q = corpus(spark, [("a.py", f"alpha word{i}") for i in range(20)]).coalesce(1), asked(spark, "alpha word7", k=5)
        for name in ("bm25", "vector"):
            got = retrieval.by_backend(name, c, q).orderBy("rank").collect()
            assert len(got) == 5 and got[0].chunk_id == "c7"
        with pytest.raises(ValueError):
            retrieval.by_backend("guess", c, q)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_queries_without_tokens_or_k_give_nothing(spark):
    assert retrieval.ranked(corpus(spark, ROWS), asked(spark, "?!")).count() == 0
    assert retrieval.ranked(corpus(spark, ROWS), asked(spark, "alpha", k=0)).count() == 0


def test_union_of_members_is_one_index(spark):
    c = corpus(spark, ROWS)
    whole = retrieval.ranked(c, asked(spark, "alpha"))
    assert [tuple(r) for r in whole.select("ord", "rank").orderBy("rank").collect()] == [tuple(r) for r in retrieval.ranked(c.where("ord < 2").union(c.where("ord >= 2")), asked(spark, "alpha")).select("ord", "rank").orderBy("rank").collect()]


def test_imports_resolve_by_stem_then_suffix(spark):
    files = spark.createDataFrame([("lib/auth.py",), ("b/auth.py",), ("c.py",), ("xyz.js",)], "file_path string")
    imports = spark.createDataFrame([("c.py", "auth"), ("c.py", "yz"), ("c.py", "c"), ("c.py", "nothing")], "file_path string, module string")
    assert sorted(map(tuple, retrieval.resolve_imports(imports, files).collect())) == [("c.py", "b/auth.py"), ("c.py", "xyz.js")]


def test_expansion_appends_neighbours(spark):
    c = corpus(spark, [("a.py", "alpha"), ("b.py", "beta one"), ("b.py", "beta two"), ("b.py", "beta three"), ("z.py", "zeta")])
    edges = spark.createDataFrame([("b.py", "a.py")], "src string, dst string")
    got = retrieval.search(c, asked(spark, "alpha", k=1), edges).orderBy("rank").collect()
    assert [r.file_path for r in got] == ["a.py", "b.py", "b.py"] and got[-1].rank == 3


def test_knowledge_drops_stale_and_boosts_merged(spark):
    base = corpus(spark, [("r1", "alpha beta"), ("r2", "alpha beta"), ("r3", "alpha beta")])
    facets = spark.createDataFrame([(0, None, ["x/pull/1"], "1"), (1, "wontfix", [], "2"), (2, None, [], "3")], "ord long, state_reason string, links array<string>, updated_at string")
    rows = base.join(facets, "ord").selectExpr("*", "'' AS title", "cast(array() AS array<string>) AS labels")
    got = retrieval.search_knowledge(rows, asked(spark, "alpha")).orderBy("rank").collect()
    assert [r.ord for r in got] == [0, 2] and abs(got[0].score / got[1].score - 1.1) < 0.05


def test_embedding_sums_are_whole():
    v = embed.embed_counts("a a b")
    assert v.sum() == int(v.sum()) and abs(v).sum() in (3, 1)


def test_relevance_and_spans(spark):
    found = spark.createDataFrame([("q", 1, "a.py", "f", 1, 4), ("q", 2, "b.py", "f", 1, 2), ("q", 3, "a.py", "g", 9, 12)], "q_id string, rank int, file_path string, kind string, start_line int, end_line int")
    wanted = spark.createDataFrame([("q", "a.py@3-10"), ("q", "c.py")], "q_id string, a string").select("q_id", quality.anchors(__import__("pyspark").sql.functions.col("a")).alias("anchor"))
    cases = spark.createDataFrame([("q", 5)], "q_id string, k int")
    s = quality.scores(found, wanted, cases).first()
    assert (s.precision, s.recall, s.mrr) == (0.4, 0.5, 1.0)
    weights = spark.createDataFrame([("a.py", 3, 5)], "file_path string, line int, weight long")
    t = quality.span_scores(found, wanted, weights).first()
    assert t.shared == 5 + 1 + 1 + 1 and t.united == 18


def test_student_t():
    t, p, low, high = quality.paired_test(5, 1.0, 1.0, 2.0)
    assert abs(t - 2.2360679775) < 1e-9 and abs(p - 0.0890091) < 1e-5 and abs(high - low - 2 * 2.7764451 / 5**0.5) < 1e-5
    assert quality.paired_test(1, 1.0, 0.0, 1.0) == (None, None, None, None)
    assert quality.paired_test(3, 0.5, 0.0, 0.5) == (None, 0.0, 0.5, 0.5)


def test_grades(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("I'm not sure", ["x"]), ("ok", ["x"]), ("The Answer is X", ["x"]), ("nothing here at all", ["x"])], "a string, m array<string>")
    assert [r.g for r in rows.select(quality.grade(F.col("a"), F.lit(None).cast("boolean"), F.col("m")).alias("g")).collect()] == ["punt", "punt", "correct", "incorrect"]


def test_saturating_sum(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([("18446744073709551615",), ("5",)], "x string").select(F.col("x").cast("decimal(38,0)").alias("x"))
    assert int(big.agg(metrics.saturating(F.col("x")).alias("s")).first()["s"]) == metrics.U64


def test_running_best_is_that_of_a_sort():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 6, (500, 3)).astype(float)
    ids, ords = np.array([f"c{i % 70}" for i in range(500)], object), np.arange(500)
    best = retrieval.Best(np.array([5, 1, 40]))
    for lo in range(0, 500, 60):
        best.add(keys[lo : lo + 60], ids[lo : lo + 60], ords[lo : lo + 60], keys[lo : lo + 60], 0)
    got = [(r.q, r.ord) for r in best.rows().itertuples()]
    want = [(q, o) for q, n in enumerate((5, 1, 40)) for _, _, o in sorted((-keys[i, q], ids[i], int(ords[i])) for i in range(500) if keys[i, q] > 0)[:n]]
    assert got == want
