"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import chat, common, components, exact, families, fingerprint, mixing, nearjoin, packing, quality, repeats, substring, suffix, tokenfile
from siltstone.llm.tokens import encoder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, size string, owner string, node string"


def text(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)] + ["Été", "naïve", "日本", "x.", "Y,"]
    shared, long = text(rng, 60, pool), text(rng, 3000, pool)
    near = text(rng, 120, pool).split()
    texts = [None, "", " \n\t ", "one", "x <|endoftext|> y", "two words", shared, shared, shared.upper(), shared + " tail of it", "head " + shared, long, long[: len(long) // 2] + " other", "a" * 5000, "b " * 700, "  double  spaces   here ", "tab\tand\x1fodd\x0bones"]
    texts += [" ".join([*near[:i], f"edit{i}", *near[i + 1 :]]) for i in range(0, 120, 9)]
    texts += [text(rng, rng.randint(1, 200), pool) for _ in range(40)]
    out = [(i * 3 % 97, t, "en", None if i % 11 == 0 else f"s{i % 4}", 0, "k", "i", "z", "o", "n") for i, t in enumerate(texts)]
    return [*out, out[5], out[20]]  # repeated rows


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def docs():
    return [(r[0], r[1] or "") for r in rows()]


@pytest.mark.parametrize("capacity, key_bits", [(None, 64), (1, 64), (2, 3)])
def test_exact(spark, capacity, key_bits):
    """With few key bits texts collide, so chains are told apart by bytes."""
    groups = defaultdict(list)
    for i, t in docs():
        groups[t.translate(FOLD)].append(i)
    want = sorted(((i, max(groups[n := t.translate(FOLD)]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in docs()), key=str)
    assert as_rows(exact.exact_groups(frame(spark), capacity=capacity, key_bits=key_bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact.keep_one(frame(spark), capacity=capacity, key_bits=key_bits)
    assert kept.columns == frame(spark).columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def counted(keys):
    """What directory() asks for, over plain 64-bit keys."""
    return lambda bits, below, prefixes: Counter(k >> (64 - bits) for k in keys if prefixes is None or k >> (64 - below) in prefixes)


def test_directory_doubles_until_no_bucket_is_overfull():
    rng = random.Random(1)
    keys = {rng.randrange(2**64) for _ in range(1000)} | {0xABCDEF << 40 | rng.randrange(2**20) for _ in range(50)}  # some share 44 bits
    slots = exact.directory(counted({k for k in keys if k >> 40 != 0xABCDEF}), 6, 40)
    depth = len(slots).bit_length() - 1
    held = Counter(slots[k >> (64 - depth)] for k in keys if k >> 40 != 0xABCDEF)
    assert len(slots) == 1 << depth > 1 and max(held.values()) <= 40 and slots == sorted(slots)
    close = {0xAB << 56 | rng.randrange(2**50) for _ in range(50)}
    slots = exact.directory(counted(close), 2, 20)  # splits go on below the bits that were counted first
    depth = len(slots).bit_length() - 1
    assert depth > 8 and max(Counter(slots[k >> (64 - depth)] for k in close).values()) <= 20
    assert exact.directory(counted(set()), 6, 40) == [0]


def test_owners_hold_whole_buckets(spark):
    """The index lies bucket by bucket, each within its capacity and in one file, and a key is found in its bucket only."""
    from pyspark.sql import functions as F

    own = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    bucket, buckets = exact.place(own, "text", 50, 64)
    found = exact.index(own, bucket, buckets).withColumn("file", F.input_file_name())
    by = found.groupBy("bucket").agg(F.countDistinct("key").alias("keys"), F.countDistinct("file").alias("files"), F.min(F.col("key").bitwiseXOR(F.lit(-(2**63)))).alias("low"), F.max(F.col("key").bitwiseXOR(F.lit(-(2**63)))).alias("high")).collect()
    assert buckets > 30 and all(r.keys <= 50 and r.files == 1 for r in by)
    ranges = sorted((r.low, r.high) for r in by)  # with the sign flipped, key ranges don't overlap
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_words(spark):
    own = [(i, WORD.findall(t)) for i, t in docs()]
    seen = Counter(tuple(w[s : s + 35]) for _, w in own for s in range(len(w) - 34))
    want = []
    for i, w in own:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = True
        kept = [x for x, g in zip(w, gone) if not g]
        want.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert as_rows(substring.repeated_words(frame(spark)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)


def brute_bytes(own, window=100):
    seen, first, out = set(), {}, {}
    for i, t in sorted(own):
        first.setdefault(t, i)
    for t, i in sorted(first.items(), key=lambda x: x[1]):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            if raw[s : s + window] in seen:
                gone[s : s + window] = True
            seen.add(raw[s : s + window])
        out[t] = gone
    want = []
    for i, t in own:
        raw, gone = t.encode(), out[t] if first[t] == i else np.full(len(t.encode()), len(t.encode()) >= window)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want.append((i, len(raw), len(raw) - len(kept), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


def unique_ids(own):
    """Texts that share an id are ordered by a hash, which the plain version doesn't know."""
    by = defaultdict(set)
    for i, t in own:
        by[i].add(t)
    return all(len(v) == 1 for v in by.values())


def test_bytes(spark):
    assert unique_ids(docs())
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_rows(suffix.repeated_bytes(frame(spark)), *columns) == brute_bytes(docs())


def test_bytes_with_crowded_anchors(spark):
    rng = random.Random(5)
    line = "the very same line of sixty bytes or so that all of them hold, "
    own = [(i, text(rng, 30, [str(j) for j in range(999)]) + " " + line * (1 + i % 2) + text(rng, 30, [str(j) for j in range(999)])) for i in range(60)]
    got = suffix.repeated_bytes(frame(spark, [(i, t, *[None] * 8) for i, t in own]))
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(own)


def test_crowded_k_gram_whose_contexts_are_first_in_another_flush():
    """Flush A calls a k-gram crowded and sends two of its contexts; flush B, not crowded and with smaller ids, holds both."""
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    middle = part(110)
    whole = [part(80) + middle + part(80) for _ in range(7)]
    find = repeats.Windows(100, (20,), "later", suffix.sequence)

    def flush(texts, first_id):
        own = pd.DataFrame({"t": [zlib.crc32(x.encode()) for x in texts], "u": 0, "id": range(first_id, first_id + len(texts)), "text": [x.encode() for x in texts]})
        return pd.concat(find._survey(1)(iter([own])))

    crowded = flush(whole[:6], 10)
    for i in range(6):  # one of the pairs is what flush A sends
        for j in range(i):
            both = pd.concat([crowded, flush([whole[i] + part(9), whole[j] + part(9), whole[6]], 1)])
            got = find._own(both[both["owner"] == 0])
            hashed = repeats.pairs_of(got["crowded"][got["id"] == 3])
            assert repeats.spread(hashed, len(whole[6]), 100)[80:190].all()


def test_rounds_keep_what_repeats_at_each_length(spark):
    """An anchor survives a round if its run occurs again; what shares 9 words but not 18 is gone after the second length."""
    rng = random.Random(31)
    word = lambda: f"u{rng.randrange(10**9)}"
    short, long = [[word() for _ in range(17)] for _ in range(12)], [word() for _ in range(60)]
    own = [(i, " ".join([w for passage in (short if i < 4 else [long]) for w in [*[word() for _ in range(30)], *passage, *[word() for _ in range(30)]]])) for i in range(8)]
    texts = repeats.distinct_texts(repeats.keyed(frame(spark, [(i, t, *[None] * 8) for i, t in own]), "doc_id", "text"))
    ids = {(r.t, r.u): r.id for r in texts.collect()}
    left = {}
    for levels in ((9, 18), (9, 18, 36)):
        alive = repeats.Windows(40, levels, "all", substring.words).survivors(texts).collect()
        left[levels] = {ids[r.t, r.u] for r in alive}
    assert left[9, 18] >= {4, 5, 6, 7} and left[9, 18] & {0, 1, 2, 3} and left[9, 18, 36] == {4, 5, 6, 7}
    lone = texts.where("id in (0, 4)")
    assert repeats.Windows(40, (9, 18, 36), "all", substring.words).survivors(lone).isEmpty()


def test_anchors_of_sequences_longer_than_the_place_bits(monkeypatch):
    rng = np.random.default_rng(5)
    raw = bytes(rng.integers(97, 99, 700, dtype=np.uint8)) + b"a" * 200
    monkeypatch.setattr(repeats, "PLACE_BITS", 12)
    want = [x.tolist() for x in repeats.contexts(suffix.sequence([raw]), 100, 20, 81)]
    # the same hashes, with places that no longer fit beside them
    batch = suffix.sequence([raw])
    monkeypatch.setattr(repeats, "PLACE_BITS", 12)
    padded = suffix.sequence([raw, bytes(rng.integers(97, 123, 5000, dtype=np.uint8))])
    got = [x.tolist() for x in repeats.contexts(padded, 100, 20, 81)]
    first = [i for i, t in enumerate(got[0]) if t == 0]
    assert len(batch.values) < 1 << 12 < len(padded.values)
    assert [[column[i] for i in first] for column in got] == want


def test_copies_fetch_their_result_without_their_text(spark):
    """Many copies of one text, with and without repeated ids."""
    rng = random.Random(8)
    t = text(rng, 80, [str(i) for i in range(5000)])
    own = [(5, t), (5, t), *[(10 + i, t) for i in range(30)], (3, text(rng, 80, [str(i) for i in range(5000)]))]
    got = suffix.repeated_bytes(frame(spark, [(i, x, *[None] * 8) for i, x in own]))
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(own)


def test_suffixes_are_in_order():
    rng = random.Random(2)
    base = bytes(rng.randrange(97, 123) for _ in range(150))
    middle = bytearray(base)
    middle[50] ^= 1
    late = bytearray(base)
    late[97] ^= 3
    periodic = b"abc" * 90
    data = base + bytes(middle) + base + bytes(late) + b"a" * 300 + periodic + base[:99]
    places = np.array([*range(0, len(data) - 100, 1), 0, 150, 300])
    buckets = np.array([rng.randrange(2) for _ in places])
    order, fresh = suffix.suffix_order(data, places, buckets, 100)
    got = [(buckets[i], (data + bytes(100))[places[i] : places[i] + 100]) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(len(places)))
    assert fresh.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
    assert all(suffix.STEPS.ravel() < suffix.CYCLE)


def test_long_ties_need_the_cover(monkeypatch):
    """With ranks that say nothing, windows that differ in the middle alone are taken for equal."""
    base = bytes(random.Random(3).randrange(97, 123) for _ in range(150))
    middle = bytearray(base)
    middle[50] ^= 1
    places, buckets = np.array([0, 150]), np.zeros(2, np.int64)
    assert suffix.suffix_order(base + bytes(middle), places, buckets, 100)[1].tolist() == [True, True]
    monkeypatch.setattr(suffix, "COVER", ())
    assert suffix.suffix_order(base + bytes(middle), places, buckets, 100)[1].tolist() == [True, False]


def shingles(t, size):
    w = WORD.findall(t.translate(FOLD))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_near(own, percent, size):
    sets, parent = [shingles(t, size) for _, t in own], list(range(len(own)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(a & b)
            if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[root(i)] = root(j)
    low = defaultdict(lambda: 2**63)
    for i, (d, _) in enumerate(own):
        low[root(i)] = min(low[root(i)], d)
    return sorted(((d, len(s), low[root(i)] if s else d, d == (low[root(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(own, sets))), key=str)


@pytest.mark.parametrize("percent, size", [(85, 3), (80, 5)])
def test_near(spark, percent, size):
    assert as_rows(nearjoin.near_groups(frame(spark), percent, size), "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs(), percent, size)


def test_near_rows_without_id_or_with_one_id_stay_linear(spark, monkeypatch):
    """As many rows reach the sets as there are, and all are told apart by their text."""
    met = []
    monkeypatch.setattr(nearjoin, "family_links", lambda sets, percent, own=nearjoin.family_links: (met.append(sets.count()), own(sets, percent))[1])
    for id_ in (None, 7):
        for n in (40, 80):
            words_ = [f"w{j}" for j in range(60)]
            own = [" ".join([*words_[:30], f"edit{i // 2}", *words_[30:]]) for i in range(n)]
            got = nearjoin.near_groups(frame(spark, [(id_, t, *[None] * 8) for t in own]), 80, 5).collect()
            assert [(r.component_id, r.kept) for r in got] == [(id_, True)] * n and met.pop() == n // 2


def test_heavy_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 8)
    monkeypatch.setattr(common, "crowd", lambda rows, least=0: rows // 8)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(90)], "k long, w long")
    got = common.meet(left, right, "k", 91)
    assert "Broadcast" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted((1 if i % 3 else i, i, (1 if i % 3 else i) * 10) for i in range(90))


def test_components_with_hubs_and_giant_labels(spark, monkeypatch):
    for module in (common, components):
        monkeypatch.setattr(module, "crowd", lambda rows, least=0: max(1, rows // 10))
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame([(a, b) for a, b in edges], "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == root


def test_near_families_larger_than_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "LEAF", 8)
    monkeypatch.setattr(families, "MEMBERS", 8)
    monkeypatch.setattr(families, "BLOCK", 32)
    rng = random.Random(9)
    base = text(rng, 150, [f"v{i}" for i in range(900)]).split()
    own = []
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        base[(i * 2) % 150] = f"n{i}"
        own.append((i, " ".join(base)))
    for i in range(40):  # a family without its origin: most pairs are refused
        own.append((100 + i, " ".join(f"e{i}.{j}" if rng.random() < 0.03 else w for j, w in enumerate(base))))
    for percent, size in ((85, 3), (80, 5)):
        got = nearjoin.near_groups(frame(spark, [(i, t, *[None] * 8) for i, t in own]), percent, size)
        assert as_rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(own, percent, size)


def origins(rng, n, edits):
    base = [f"b{i}" for i in range(300)]
    return [" ".join(f"e{i}.{j}" if j in gone else w for j, w in enumerate(base)) for i in range(n) for gone in [set(rng.sample(range(300), edits))]]


def test_refused_pairs_are_never_rows(spark, monkeypatch):
    """Candidates and links of a family of which most pairs are refused grow with its size, not with its square."""
    monkeypatch.setattr(nearjoin, "LEAF", 64)
    rows_at = {}
    for n in (100, 200, 400):
        own = [(i, t, *[None] * 8) for i, t in enumerate(origins(random.Random(3), n, 9))]
        sets = nearjoin.shingle_sets([r[1].encode() for r in own], 3)
        nodes = [(nearjoin.named(s) - 2**64 if nearjoin.named(s) >= 2**63 else nearjoin.named(s), i, nearjoin.signature(s).tobytes()) for i, s in enumerate(sets)]
        rows_at[n] = nearjoin._candidates(spark.createDataFrame(nodes, "node long, id long, signature binary").select("node", "signature"), 85).distinct().count()
    assert rows_at[400] <= 8 * 400 * nearjoin.TREES and rows_at[400] <= 2.5 * rows_at[200] <= 6.25 * rows_at[100]


def test_wide_families_branch_exactly(spark):
    """Families solved in one task and by branching give the same components."""
    rng = random.Random(17)
    sets = []
    for origin in range(3):
        base = rng.sample(range(2000), 200) if origin < 2 else [*sets_base[:180], *range(5000, 5020)]
        sets_base = base
        for _ in range(40):
            own = [x if rng.random() > 0.05 else 9000 + rng.randrange(40) for x in base]
            sets.append(np.unique(np.array(own, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for percent in (85,):
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    low, high = sorted((want[i], want[j]))
                    want = [low if w == high else w for w in want]
        items = spark.createDataFrame([(1, i, 2 * percent * len(s), s.tobytes()) for i, s in enumerate(sets)], families.ITEM)
        for members, block in ((1000, None), (16, 1000), (16, 25)):
            got = list(range(len(sets)))
            for a, b in families.family_links(items, percent, members, block).collect():
                low, high = sorted((got[a], got[b]))
                got = [low if w == high else w for w in got]
            assert got == want, (percent, members, block)


def test_near_recall_on_the_driver_tables(spark):
    """Every document of sf0.01 against brute force by an inverted index; prints recall of links."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = [(r.doc_id, r.text or "") for r in docs_.collect()]
    sets = [shingles(t, 3) for _, t in own]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    shared = Counter((i, j) for x in held.values() for at, j in enumerate(x) for i in x[:at])
    links = [(i, j) for (i, j), n in shared.items() if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n)]
    label = {r.doc_id: r.component_id for r in nearjoin.near_groups(docs_, 85, 3).collect()}
    found = sum(label[own[i][0]] == label[own[j][0]] for i, j in links)
    print(f"recall of {len(links)} links: {found / max(1, len(links))}")
    assert found == len(links) > 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(*values):
    """Spark's xxhash64 of a string, or of numbers in a chain."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def plain_anchors(t, k=5, piece=12):
    runs = WORD.findall(t)
    h = [xx(p) for r in runs for p in ([r] if len(r) <= piece else [r[i : i + 8] for i in range(len(r))])]
    p = [xx(a, b) for a, b in zip(h, h[1:])]
    closed = [(i, xx(p[i], p[i + 2], h[i + 4]) % 2**64 >> 16) for i in range(len(h) - k + 1) if min(p[i : i + k - 1]) in (p[i], p[i + k - 2])]
    closed = [x for i, x in enumerate(closed) if i == 0 or closed[i - 1][1] != x[1]]
    return closed or ([(0, xx(t) % 2**64 >> 16)] if t else [])


def alike(a, b):
    a, b = {x for _, x in a}, {x for _, x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_are_those_of_the_plain_version(spark):
    order = sorted(((-i, t) for i, t in docs()), key=lambda x: (x[0], x[1]))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        shown = [" ".join(f"{x:012x}@{at}" for at, x in plain_anchors(y)) for y in (t, edited)]
        want.append((-i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *shown, alike(plain_anchors(t), plain_anchors(edited)), alike(plain_anchors(t), plain_anchors(n))))
    got = fingerprint.fingerprints(frame(spark))
    assert as_rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want, key=str)


def test_only_the_empty_text_has_an_empty_fingerprint(spark):
    rng = random.Random(1)
    own = [" " * n for n in range(1, 4)] + [text(rng, rng.randint(1, 7), [f"z{j}" for j in range(50)]) for _ in range(60)]
    got = fingerprint.fingerprints(frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(own)])).collect()
    assert all(r.fingerprint for r in got)
    by = {r.doc_id: r.fingerprint for r in got}
    assert all((own[i] == own[j]) >= (by[i] == by[j]) or plain_anchors(own[i]) == plain_anchors(own[j]) for i in by for j in by)


def test_an_edit_in_front_of_an_unspaced_text_leaves_its_anchors():
    rng = random.Random(2)
    for alphabet in ("abcdefghijklmnop", "日本語文字列検索順位計算"):
        t = "".join(rng.choice(alphabet) for _ in range(600))
        assert alike(plain_anchors(t), plain_anchors("X" + t)) > 0.8


def test_unspaced_texts_of_few_letters_are_told_apart():
    rng = random.Random(5)
    a, b = ("".join(rng.choice("ACGT") for _ in range(8000)) for _ in range(2))
    assert alike(plain_anchors(a), plain_anchors(b)) < 0.2 and alike(plain_anchors(a), plain_anchors("X" + a)) > 0.8


def test_ids_are_dealt_over_many_cuts(spark):
    """The number of a row's range is found by halving the cuts; with most ids a cut, rows still meet the next."""
    rng = random.Random(8)
    own = [(i * 3 - 400, f"text {i} {rng.random()}") for i in range(300)] + [(5, "again"), (5, "and again"), (None, "z"), (None, "a")]
    rows_ = spark.createDataFrame(own, "doc_id long, text string")
    order = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {(*r, n[1]) for r, n in zip(order, [*order[1:], order[0]])}
    for n in (1, 2, 7, 250):
        got = fingerprint.with_next(rows_, {}, ["text"], n)
        assert {tuple(r) for r in got.select("doc_id", "text", "next_text").collect()} == want


def test_fingerprints_separate_edits_from_strangers(spark):
    rng = random.Random(4)
    own = [(i, text(rng, 200, [f"q{j}" for j in range(5000)]), *[None] * 8) for i in range(30)]
    got = fingerprint.fingerprints(frame(spark, own)).collect()
    assert min(r.near_edited for r in got) > 0.25 > max(r.near_next for r in got)


def test_token_file(spark, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    order = sorted(docs())
    want, start = [], 0
    for i, t in order:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert as_rows(tokenfile.through_file(frame(spark), path, block_ids=500), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_elias_fano():
    rng = random.Random(8)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        values = np.cumsum([rng.choice((0, 1, 1, 3, 5000)) for _ in range(n)])
        ef = tokenfile.EliasFano.of(values)
        assert [ef.select(i) for i in range(n)] == values.tolist()


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_encoding_is_the_tokenizers(name, kind):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    odd = ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "don't STOP. it's", "x,,y .", "É é ÀÇ ß İstanbul ΣΑΣ", "é É", "<|endoftext|> x", "x <|endoftext|>", "a<|ENDOFTEXT|>b <|startoftext|>c", "a b  c", "日本 語.", "1.5, 2.", "A.B,", "\x1c\x1d z", "tab\tx"]
    encode = encoder(vocabulary(name), kind)
    for t in [*odd, *[t for _, t in docs()]]:
        assert encode(t) == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = []
    for i, t in docs():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack(frame(spark), vocabulary("byte_bpe_50k.json"))
    assert as_rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 2


def test_fullest_combination():
    rng = random.Random(6)
    for _ in range(30):
        counts = Counter(rng.randint(1, 60) for _ in range(10))
        got = dict(packing.fullest(dict(counts), 100, max(counts)))
        assert all(n <= counts[k] for k, n in got.items())
        reach = {0}
        rest = counts - Counter([max(counts)])
        for v in rest.elements():
            reach |= {r + v for r in reach if r + v <= 100 - max(counts)}
        assert sum(k * n for k, n in got.items()) == max(counts) + max(reach)


def test_slack_plan_is_no_worse_than_best_fit_decreasing():
    rng = random.Random(1)
    kinds = (lambda: rng.randint(1, 1024), lambda: rng.randint(100, 400), lambda: min(1024, int(rng.lognormvariate(5.5, 0.8)) + 1), lambda: rng.choice((1024, 300, 341, 500, 200, 77)))
    for n in (1, 20, 300, 2000):
        for kind in kinds:
            counts = Counter(kind() for _ in range(n))
            got, held = packing.plan(dict(counts), 1024), Counter()
            for _, times, chosen in got:
                assert sum(size * k for size, k in chosen) <= 1024
                held.update({size: k * times for size, k in chosen})
            bins = sum(times for _, times, _ in got)
            assert held == counts and bins >= -(-sum(size * k for size, k in counts.items()) // 1024)
            free, plain = [], 0
            for size in sorted(counts.elements(), reverse=True):
                at = bisect.bisect_left(free, size)
                if at < len(free):
                    left = free.pop(at) - size
                else:
                    plain, left = plain + 1, 1024 - size
                bisect.insort(free, left)
            assert bins <= plain


def test_mixing(spark):
    own = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows()]
    sizes = Counter()
    for _, s, n in own:
        sizes[s] += n
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
    got = mixing.mix(frame(spark)).collect()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert as_rows(mixing.mix(frame(spark)), "doc_id", "taken", "position") == sorted(((r.doc_id, r.taken, r.position) for r in got), key=str)
    spots = [r.position for r in got]
    assert spots == sorted(spots, key=lambda x: (x is not None, x))  # range-sorted, as it is collected


def test_sequence_takes_whole_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 1)  # more buckets than the least number
    own = mixing.mix(frame(spark)).collect()
    want = Counter()
    for r in own:
        first = min(r.taken, r.size)
        want[r.doc_id] += (r.taken > 0) * ((2 * first >= r.size) + (r.position_again is not None and 2 * (r.taken - r.size) >= r.size))
    got = mixing.sequence(frame(spark))
    assert got.columns == frame(spark).columns
    assert Counter(r.doc_id for r in got.collect()) == +want
    words_, target = Counter(), {r.source: r.target for r in own}
    longest = {s: max(r.size for r in own if r.source == s) for s in target}
    for r in got.collect():
        words_[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(words_[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_sequence_of_a_source_with_one_long_document(spark):
    own = [(1, "w " * 1000, "en", "a", 0, *["x"] * 5), (2, "v " * 10, "en", "b", 0, *["x"] * 5)]
    got = mixing.sequence(frame(spark, own), weights=(1, 1), share=0.03).collect()
    assert [r.doc_id for r in got] == [2, 2]  # 3 % of a's words are less than half of its document


CLASH = "doc_id long, text string, source string, _key long, _sha string, key string, bucket int, sha string, keep_id long, group_size long, norm string, mark string, spot double, at int, same string, _size long, _keep long, id string, node long"


def test_columns_of_any_name_pass(spark):
    own = [(i, t, "s", 7, "mine", "k", 1, "s", 5, 9, "n", "m", 0.5, 3, "same", 4, 6, "id", 8) for i, t in ((1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, ""), (4, ""))]
    rows_ = spark.createDataFrame(own, CLASH)
    for kept in (exact.keep_one(rows_), nearjoin.keep_first(rows_), mixing.sequence(rows_)):
        assert kept.columns == rows_.columns
        assert {tuple(r)[2:] for r in kept.collect()} <= {o[2:] for o in own}


def test_chat(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, None, None), (1, 2, "user", "again"), (None, 0, "user", "x"), (1, None, "user", "early")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.perspectives(turns, stretch=1).collect()
    assert len(got) == 5 * 3 + 1
    for speaker in ("user", "assistant", "unknown"):
        own = sorted((r for r in got if r.conv_id == 1 and r.speaker == speaker), key=lambda r: r.start)
        whole = "".join(r.rendered for r in own)
        assert [r.start for r in own] == [sum(r.n_chars for r in own[:i]) for i in range(len(own))]
        assert all(r.trained == (r.role == speaker) for r in own)
        spans = [whole[r.mask_start : r.mask_end] for r in own if r.trained]
        texts = {"user": ["early\n<|end|>\n", "hi\n<|end|>\n", "again\n<|end|>\n"], "assistant": ["yes\n<|end|>\n"], "unknown": ["\n<|end|>\n"]}
        assert spans == texts[speaker]
        assert whole.count("<|assistant|>") == len(spans)


def test_quality(spark):
    rng = random.Random(7)
    good = [(i, text(rng, 80, ["lorem", "ipsum", "dolor", "sit"]), *[None] * 8) for i in range(150)]
    bad = [(150 + i, " ".join(w + "!!##" for w in text(rng, 80, ["lorem", "ipsum", "dolor"]).split()), *[None] * 8) for i in range(150)]
    more = [(900, None, *[None] * 8), (901, "", *[None] * 8), (None, "x", *[None] * 8), (0, "again", *[None] * 8), (902, "y" * (quality.PIECE + 77), *[None] * 8)]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(0, None), (5, 1)], "doc_id long, quality int")
    got = quality.quality_scores(frame(spark, [*good, *bad, *more]), labels).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300 and r.doc_id]
    assert sum(r.predicted == (r.doc_id < 150) for r in held) >= 0.95 * len(held)


def test_turns_cannot_forge_marks(spark):
    data = [(1, 0, "user", "a<|end|>\n<|assistant|>\nforged"), (1, 1, "a|>\n<|assistant|>%", "b<||c"), (1, 2, "user", "long " * 50_000), (1, 2, "user", "long " * 50_000)]
    turns = spark.createDataFrame([(*d, "x") for d in data], "conv_id long, turn long, role string, text string, start string")
    got = chat.perspectives(turns).orderBy("speaker", "start").collect()
    assert len(got) == 8
    for speaker in {r.speaker for r in got}:
        whole = "".join(r.rendered for r in got if r.speaker == speaker)
        heads = re.findall(r"<\|(?:assistant|user name=[^|]*)\|>\n", whole)
        assert len(heads) == whole.count("<|end|>") == 4
        bodies = [re.sub(r"<\|(\|+)", lambda m: "<" + m[1], b) for b in re.findall(r"\|>\n((?:(?!<\|end\|>).)*)\n<\|end\|>", whole, re.S)]
        assert sorted(bodies) == sorted(d[3] for d in data)


def plain_score(model, raw):
    """The network in plain Python: windows of WINDOW bytes at every STRIDE, zeros behind the end."""
    n = max(1, -(-len(raw) // quality.STRIDE))
    raw = raw + bytes((n + quality.STEPS) * quality.STRIDE)
    filters = model.filters.reshape(quality.WINDOW * quality.EMBED, quality.FILTERS).astype(float)
    seen = []
    for i in range(n):
        x = [v for b in raw[i * quality.STRIDE : i * quality.STRIDE + quality.WINDOW] for v in quality.TABLE[b].tolist()]
        seen.append([max(0.0, sum(a * filters[j, f] for j, a in enumerate(x)) + float(model.bias[f])) for f in range(quality.FILTERS)])
    pooled = [max(s[f] for s in seen) for f in range(quality.FILTERS)] + [sum(s[f] for s in seen) / n for f in range(quality.FILTERS)]
    z = sum(p * float(w) for p, w in zip(pooled, model.weights)) + model.base
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_quality_scores_are_those_of_the_plain_network(spark):
    rng = random.Random(3)
    own = [(i, ("!! " if i % 2 else "") + text(rng, rng.randint(0, 12), ["lorem", "ipsum", "Été", "日本", "12"]), *[None] * 8) for i in range(40)] + [(90, None, *[None] * 8), (91, "", *[None] * 8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(frame(spark, own), labels)
    want = {r[0]: plain_score(model, (r[1] or "").encode()) for r in own}
    got = quality.quality_scores(frame(spark, own), labels).collect()
    assert len(got) == 42 and all(abs(r.score - want[r.doc_id]) < 1e-5 for r in got)


def test_quality_learns_from_bounded_bytes_and_ignores_the_held_out_fold(spark):
    own = [(i, f"text {i} " * 10, *[None] * 8) for i in range(60)] + [(99, "z" * 100_000, *[None] * 8)]
    labels = [(i, i % 2) for i in range(60)] + [(99, 1)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    schema = "doc_id long, quality int"
    a = quality.fit(frame(spark, own), spark.createDataFrame(labels, schema), sample_bytes=3000)
    b = quality.fit(frame(spark, own), spark.createDataFrame(turned, schema), sample_bytes=3000)
    assert (a.filters == b.filters).all() and a.base == b.base


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    texts, labels = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 5, 40, 90)], np.array([0.0, 1.0, 1.0, 0.0])
    model = quality.Model(rng.normal(0, 0.3, (quality.STEPS, quality.STRIDE * quality.EMBED, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.1)

    def loss(m):
        p = np.array([plain_score(m, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality.gradients(model, texts, labels, len(texts))
    for value, grad in ((model.filters, grads[0]), (model.bias, grads[1]), (model.weights, grads[2])):
        for _ in range(4):
            at = tuple(rng.integers(0, d) for d in value.shape)
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss(model)
            value[at] = kept - step
            down = loss(model)
            value[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-3


def test_pooling_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(32, 127, 5003).astype(np.uint8).tobytes()
    model = quality.train([b"a" * 50, b"#!" * 30], np.array([1.0, 0.0]), epochs=1)
    whole = quality.pool(model, [raw, b"", b"ab"])
    monkeypatch.setattr(quality, "PIECE", 1024)
    assert np.allclose(quality.pool(model, [raw, b"", b"ab"]), whole, atol=1e-4)


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (exact.exact_groups(none), exact.keep_one(none), nearjoin.keep_first(none), mixing.sequence(none), substring.repeated_words(none), suffix.repeated_bytes(none), nearjoin.near_groups(none), fingerprint.fingerprints(none), mixing.mix(none),
               tokenfile.through_file(none, vocabulary("word_bpe_49k.json")), packing.pack(none, vocabulary("byte_bpe_50k.json")), quality.quality_scores(none, labels),
               chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert df.count() == 0


def test_null_ids_do_not_crash(spark):
    some = frame(spark, [(None, "a b c d", *[None] * 8), (None, "a b c d", *[None] * 8), (3, "e f g", *[None] * 8)])
    for df in (exact.exact_groups(some), substring.repeated_words(some), suffix.repeated_bytes(some), nearjoin.near_groups(some), fingerprint.fingerprints(some), mixing.mix(some), tokenfile.through_file(some, vocabulary("word_bpe_49k.json")), packing.pack(some, vocabulary("byte_bpe_50k.json"))):
        assert df.count() == 3


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1000, 257).astype(np.uint64)
    for w in (1, 2, 18, 81, 257):
        assert repeats.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]
