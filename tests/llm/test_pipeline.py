"""The pipeline's stages on the smallest tables and on odd rows, each against a plain version of what it decides."""

import random
from collections import Counter, defaultdict

import pytest
from test_operators import FOLD, WORD, brute_near

import corpus_pipeline
from siltstone.llm import quality

SF = "/root/testdata/sf0.001"


def plain_mix(own):
    """Documents as often as the mix takes them: own: (id, text, source) rows of which no two repeat id and text."""
    import hashlib

    sizes = Counter()
    for _, t, s in own:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        open_ -= over
    taken = Counter()
    for s in names:
        rows = sorted((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t) for i, t, o in own if o == s)
        goal, done = round(target[s]), 0
        for lap in range(2):
            for mark, i, t in rows:
                n = len(WORD.findall(t or ""))
                take = max(0, min(n, goal - done))
                taken[i, t] += take > 0 and 2 * take >= n
                done += n
    return +taken


def check_stages(spark, docs, sf_dir):
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == columns
        at = {c: i for i, c in enumerate(columns)}
        old, new = [tuple(r) for r in kept.collect()], [tuple(r) for r in after.collect()]
        of = lambda r, c: r[at[c]]
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = model.score(quality.pool(model, [(of(r, "text") or "").encode() for r in old]))
            assert Counter(r for r, s in zip(old, scores) if s >= 0.5) == Counter(new)
        elif name == "exact dedup":
            best = defaultdict(list)
            for r in old:
                best[(of(r, "text") or "").translate(FOLD)].append(r)
            lead = lambda r: (of(r, "doc_id") is not None, of(r, "doc_id") or 0)
            assert sorted(map(str, (of(max(g, key=lead), "doc_id") for g in best.values()))) == sorted(str(of(r, "doc_id")) for r in new)
        elif name == "near dedup":
            last = 2**63 - 1  # what a missing id counts as
            want = brute_near([(last if of(r, "doc_id") is None else of(r, "doc_id"), of(r, "text") or "") for r in old], 80, 5)
            assert sorted(d for d, _, _, keep in want if keep) == sorted(last if of(r, "doc_id") is None else of(r, "doc_id") for r in new)
        else:
            assert Counter((of(r, "doc_id"), of(r, "text")) for r in new) == plain_mix([(of(r, "doc_id"), of(r, "text"), of(r, "source")) for r in old])
        assert set(new) <= set(old)
        kept = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert pieces.where("offset + length > 1024").count() == 0
    assert pieces.where("piece = 0").count() == kept.count()
    return pieces


def test_stages(spark):
    assert len(corpus_pipeline.STAGES) == 5
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet").cache(), SF)


def odd_rows():
    rng = random.Random(1)
    long = " ".join(rng.choice(["river", "stone", "valley", "winter", "harbour"]) + str(rng.randrange(99)) for _ in range(30_000))
    near = [f"plain{i}" for i in range(100)]
    texts = [None, "", " \n ", "one", "one", "ONE", long, long, " ".join(near), " ".join([*near[:50], "edit", *near[51:]]), "日本語 " * 30, "a" * 4000]
    return [(i, t, "en", None if i % 5 == 0 else f"s{i % 2}", 0, "mine", 7, "k") for i, t in enumerate(texts)] + [(None, " ".join([*near[:30], "none", *near[31:]]), "en", "s1", 0, "mine", 7, "k"), (None, "of its own without an id", "en", "s1", 0, "mine", 7, "k")] + [(3, "one", "en", None, 0, "mine", 7, "k"), (3, "other text of the same id", "en", "s1", 0, "mine", 7, "k")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, spot long, mark string"


def test_stages_on_nulls_long_texts_ties_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda *a, **k: quality.train([], __import__("numpy").zeros(0)))  # one score for every text
    check_stages(spark, spark.createDataFrame(odd_rows(), SCHEMA).cache(), SF)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None)]])
def test_stages_on_empty_tables_and_rows(spark, rows):
    pieces = check_stages(spark, spark.createDataFrame(rows, SCHEMA).cache(), SF)
    assert pieces.count() == 0  # nothing, or a document without words, which the mix never takes
