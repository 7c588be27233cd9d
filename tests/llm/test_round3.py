"""Structure repair, clustering and near vectors against plain versions, on nulls, ties, repeats, odd rows and empty tables."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from siltstone.llm import dualtree, queries, signs, structure

WHITE = " \t\n\x0b\x0c\r"
GO = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(turns):
    """Cheapest edits by a search over (turn, state), the ASCII-least audit among equal costs: (cost, audit, pieces)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, pieces = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, pieces
        if (i, state) in done:
            continue
        done.add((i, state))
        for x, to in GO[state].items():
            if x != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*pieces, ({"u": "user", "a": "assistant"}[x], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, pieces))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for x, to in GO[state].items():
                    if role[:1] == x:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*pieces, (role, text))))
                    if x != "s":
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to, (*pieces, ({"u": "user", "a": "assistant"}[x], text))))
    raise AssertionError


def plain_report(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    groups = defaultdict(list)
    for c, t, r, x in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if lot:
            x = "" if lot == 1 else x.translate(str.maketrans("", "", ".!?")) if lot == 2 else x
            groups[c] += [(t, "user" if lot == 4 else r, x)] * (1 + (lot == 3))
    out = []
    for c in {c for c, *_ in rows}:
        own, seen, turns = sorted(groups[c], key=lambda g: (g[0] is not None, g[0] or 0, g[1], g[2])), set(), []
        for _, r, x in own:
            end = x.rstrip(WHITE)
            turns.append((r, x, "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else ""))
            seen.add((r, x))
        at = [t for t, *_ in own if t is not None]
        cost, audit, pieces = plain_repair(turns)
        count = lambda f: sum(t[2] == f for t in turns)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in pieces).encode()).hexdigest()
        out.append((c, max(at) - min(at) + 1 - len(set(at)) if at else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def talks(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system"] * 2 + ["user", "assistant"] * 4 + ["tool", "", None, "User", "system_note", "über"])
            text = rng.choice([f"Text {rng.randint(0, 3)}.", "Same!", "cut off", "cut. off \t", " \n", "", None, "Really?\x0b", "日本。", "nbsp "])
            rows.append((None if c == 5 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 3]), role, text))
    return rows


TALKS = "conv_id long, turn long, role string, text string, conv string, place string, symbol string, _lot string"


def test_structure_repair(spark):
    rows = talks(1, 250) + [(7000, 2**63 - 1, "user", "a."), (7000, -(2**63) + 5, "assistant", "b.")] + [(8000, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(700)]
    df = spark.createDataFrame([(*r, "c", "p", "s", "l") for r in rows], TALKS)
    got = sorted((tuple(r) for r in structure.report(df, structure.damage(df)).collect()), key=str)
    want = [(c, min(g, 2**63 - 1), *more) for c, g, *more in plain_report(rows)]
    assert got == want
    assert structure.report(df.limit(0), structure.damage(df.limit(0))).count() == 0


def test_structure_automaton_against_search():
    rng, automaton = random.Random(2), structure.Automaton()
    for _ in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), str(i), rng.choice(["", "", "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 9))]
        symbols = bytes(4 * max(0, "?sua".find(r[0])) + ["", "blank", "duplicate", "truncated"].index(f) for r, _, f in turns)
        cost, states, best = automaton.scan(symbols)
        assert (cost, "".join(a for a, _ in automaton.audit(symbols, states, best))) == plain_repair(turns)[:2]
    assert len(automaton.vectors) < 100  # states of the table stay few however many conversations pass


def test_structure_streams_span_batches(spark):
    """One conversation over several Arrow batches, and several in one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = talks(3, 30) + [(900, i, "user", f"{i}") for i in range(60)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert sorted((tuple(r) for r in structure.report(df, structure.damage(df)).collect()), key=str) == plain_report(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("seed", range(12))
def test_cover_tree(seed):
    rng = np.random.default_rng(seed)
    points = np.unique(rng.integers(-40, 40, (rng.integers(1, 300), rng.integers(1, 6))), axis=0)
    if seed % 3 == 0:
        points = np.unique(np.concatenate([points + 500 * j for j in range(4)]), axis=0)
    if seed % 4 == 1:
        points = points * ((1 << 26) // np.abs(points).max())  # beyond what products of doubles hold exactly
    tree = dualtree.CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2).astype(float))
    for i, p in enumerate(tree.centre):
        own, kids = tree.order[tree.lo[i] : tree.hi[i]], tree.kids[tree.first[i] : tree.first[i + 1]]
        assert p in own and apart[p, own].max() <= tree.radius[i]  # covering
        assert sorted(x for k in kids for x in tree.order[tree.lo[k] : tree.hi[k]]) == (sorted(own) if len(kids) else []) and (not len(kids) or p in tree.centre[kids])  # nesting
        inner = [apart[a, b] for a in tree.centre[kids] for b in tree.centre[kids] if a != b]
        assert not inner or max(inner) <= 8 * min(inner)  # separation: siblings are of one scale
    centroids = np.concatenate([points[rng.integers(0, len(points), 12)], points[:2], points[:2]]) + seed % 2
    found, compared = dualtree.nearest(tree, points, centroids)
    assert (found == ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()
    if seed % 3 == 0:
        assert compared < len(points) * len(centroids) / 2


def plain_clusters(rows, k=16):
    kept = [(i, np.floor(np.array(v, float) * 64).astype(int)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    v = np.stack([q for _, q in kept])
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", tuple(map(int, q))) for i, q in kept)[:k]
    c = np.array([q for _, q in seeds])
    for _ in range(3):
        own = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = v[own == j].sum(0) // (own == j).sum()
    far = ((v[:, None] - c[None]) ** 2).sum(2)
    own, low = far.argmin(1), far.min(1)
    mark = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((i, int(o), int(d), int(low[own == o].sum()), int(low.sum()), mark[o]) for (i, _), o, d in zip(kept, own, low)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, id string, q string, x string, node string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], VECTORS)


def test_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 64))
    rows = [(None if i % 60 == 7 else i * 5 % 211, (base[i % 6] + rng.standard_normal(64) * 0.3).tolist()) for i in range(220)]
    rows += [(i, base[0].tolist()) for i in range(90)] + [(500, [0.25] * 64), (501, None), (502, []), (503, [1.0] * 63), (504, [None] + [1.0] * 63), (505, [float("nan")] * 64), (506, [float("inf")] + [1.0] * 63), (507, [-0.0] * 64)]
    monkeypatch.setattr(dualtree, "BLOCK", 50)
    for own in (rows, rows[:5], rows[:0], [(1, [3e30] * 64), (2, [-3e30] * 64)]):
        got = sorted((tuple(r) for r in dualtree.clusters(vectors(spark, own)).collect()), key=str)
        if own and own[0][1][0] == 3e30:  # beyond what is kept apart
            assert [r[2] for r in got] == [0, 0] and len(got) == 2
        else:
            assert got == plain_clusters(own)


def plain_near(rows, least=0.9):
    ids, vecs = [i for i, _ in rows], [v for _, v in rows]
    good = [i for i, v in enumerate(vecs) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(ids), list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for width in {len(vecs[i]) for i in good}:
        own = [i for i in good if len(vecs[i]) == width]
        x = np.array([vecs[i] for i in own])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for a, near in zip(own, x @ x.T >= least):
            for b in (own[j] for j in np.flatnonzero(near)):
                links[a] += a != b
                root[max(top(a), top(b))] = min(top(a), top(b))
    big, low = 2**63 - 1, {}
    for i, n in enumerate(ids):
        low[top(i)] = min(low.get(top(i), big), big if n is None else n)
    return sorted(((n, links[i], None if low[top(i)] == big else low[top(i)], (big if n is None else n) == low[top(i)]) for i, n in enumerate(ids)), key=str)


@pytest.mark.parametrize("more", [{}, {"cell": 16, "limit": 20, "crowd": 20, "miss": 1e-6}])
def test_near_vectors(spark, more):
    """With small cells crowded ones give cores, and are cut into blocks."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((3, 8))
    vecs = [(centre[i % 3] + rng.standard_normal(8) * [0.05, 0.2, 0.4][i % 3]).tolist() for i in range(240)] + rng.standard_normal((200, 8)).tolist()
    vecs += [None, [], [0.0] * 8, [1.0] * 7, [None] + [1.0] * 7, [float("nan")] * 8, [1.0] * 7, vecs[0], vecs[0], [2.0 * x for x in vecs[0]], [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7, [1e300] * 8, [1e-300] * 8]
    rows = [(None if i % 50 == 0 else i * 7 % 401, v) for i, v in enumerate(vecs)]
    assert sorted((tuple(r) for r in signs.near_vectors(vectors(spark, rows), **more).collect()), key=str) == plain_near(rows)


def test_near_vectors_of_nothing(spark):
    assert signs.near_vectors(vectors(spark, []).limit(0)).count() == 0
    assert sorted(tuple(r) for r in signs.near_vectors(vectors(spark, [(3, None), (4, [0.0])])).collect()) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_cores_need_no_comparison(spark):
    """A group of near copies, all within half the angle of its middle, is counted without a row a pair."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(64)
    rows = [(i, (middle + rng.standard_normal(64) * 0.1).tolist()) for i in range(900)]
    got = signs.near_vectors(vectors(spark, rows), cell=64, limit=100, crowd=100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(899, 0)}


def test_spanning():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = int(rng.integers(2, 60)), int(rng.integers(0, 80))
        a, b = rng.integers(0, n, (2, m))
        tree = signs.spanning(a, b, n)

        def roots(pairs):
            root = list(range(n))
            for x, y in pairs:
                root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
            return root

        assert roots(zip(a, b)) == roots(zip(a[tree], b[tree])) and len(tree) == n - len(set(roots(zip(a, b))))


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_near_vectors"])
def test_against_sql(spark, tmp_path, name):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((20, 64)).astype("f4")
    rows = [(i, (base[i % 20] + rng.standard_normal(64) * [0.1, 0.3, 1][i % 3]).astype("f4").tolist()) for i in range(150)] + [(900, None), (901, [None] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
