import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import chunking
from siltstone.operators import metrics, retrieval
from siltstone.plans.engine import Engine
from siltstone.sources import artifacts, files, ndjson, workspace


def test_packs_find_their_own_samples():
    assert all(not wrong for wrong in chunking.Registry().validate().values())
    with pytest.raises(ValueError):
        chunking.Registry([*chunking.PACKS, chunking.PACKS[0]])


def test_chunks_cover_definitions_and_fall_back():
    reg = chunking.Registry()
    py = "class A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    assert [(r[1], r[2], r[4], r[5]) for r in chunking.code_chunks("a.py", py, reg)] == [(1, 3, "class_definition", "A"), (2, 3, "function_definition", "f"), (5, 6, "function_definition", "g")]
    assert [(r[1], r[2], r[3]) for r in chunking.code_chunks("a.py", "def broken(:\n", reg)] == [(1, 2, "module")]
    rust = "use std::io;\nstruct U;\nimpl U {\n  fn new() -> U { U }\n}\n"
    assert [(r[1], r[2], r[4]) for r in chunking.code_chunks("a.rs", rust, reg)] == [(2, 2, "struct_item"), (3, 5, "impl_item"), (4, 4, "function_item")]
    c = "/* f() { */\nint f(int a) {\n  char *s = \"}\";\n  return a;\n}\n"
    assert [(r[1], r[2], r[5]) for r in chunking.code_chunks("a.c", c, reg)] == [(2, 5, "f")]


def test_markdown_sections():
    text = "intro\n\n# A\ntext\n## B\n```\n# no\n```\n## C\nmore\n\nTitle\n=====\nend\n"
    assert [(r[1], r[5]) for r in chunking.markdown_chunks("a.md", text, 3)] == [(1, ""), (3, "A"), (5, "A > B"), (9, "A > C"), (12, "Title")]
    assert len(chunking.markdown_chunks("a.md", text, 400)) == 3
    assert [r[3] for r in chunking.markdown_chunks("a.md", ">" * 500 + " # x", 400)] == ["module"]


def test_imports():
    reg = chunking.Registry()
    assert chunking.imports_of("a.py", "import os.path, re\nfrom a.b import c\nimport re\n", reg) == ["os", "re", "a"]
    assert chunking.imports_of("a.ts", "import x from '@s/b/c'; const y = require('./u/z');", reg) == ["@s/b", "u"]
    assert chunking.imports_of("a.c", '#include "dir/x.h"\n', reg) == ["x"]


def test_tree_to_search(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/auth.py").write_text('import pay\n\ndef login(user):\n    password = "hunter2hunter2"\n    return user\n')
    (tmp_path / "src/pay.py").write_text("def charge(card):\n    return card\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("def never(): pass\n")
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "keep.log").write_text("no")
    scanned = files.scan(spark, str(tmp_path), files.gitignore(["*.log", "!other.log"]))
    assert {r.file_path: r.reason for r in scanned.collect()} == {"src/auth.py": None, "src/pay.py": None, ".env": "sensitive"}
    engine = Engine(spark)
    tables = engine.index(str(tmp_path), files.gitignore(["*.log"]))
    assert "hunter2" not in " ".join(r.content for r in tables["chunks"].collect())
    engine.save(tables, str(tmp_path / "store"))
    tables = engine.load(str(tmp_path / "store"))
    got = engine.search(tables, engine.queries("login user", k=1)).orderBy("rank").collect()
    assert [r.file_path for r in got] == ["src/auth.py", "src/pay.py"]
    assert engine.doctor(tables).first().bad_ids == 0


def test_event_log_is_tolerant_and_typed(spark, tmp_path):
    lines = [
        {"event": "search", "ts": "2026-07-04T10:00:00Z", "id": "a", "tokens_saved": 10, "savings_ratio": 0.5, "result_count": 1, "top_score": 0.9},
        {"event": "search", "ts": "2026-07-04T11:00:00Z", "id": "b", "tokens_saved": 3.0, "empty": "true", "source": "mcp"},
        {"event": "feedback", "ts": "2026-07-04T12:00:00Z", "target_id": "a", "helpful": True},
        {"event": "else", "ts": "2026-07-04T12:00:00Z"},
        {"event": "search", "ts": "yesterday"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n\n")
    log, skipped = ndjson.read_log(spark, str(tmp_path / "log.jsonl"))
    assert skipped.first().skipped == 3
    t = metrics.totals(log, 3.0).first()
    assert (t.searches, t.feedback, int(t.tokens_saved), t.helpful_rate) == (2, 1, 10, 1.0)
    assert {r.source: r.searches for r in metrics.by_source(log).collect()} == {"cli": 1, "mcp": 1}
    assert [r.feedback for r in metrics.recent(log).orderBy("place").collect()] == ["none", "helpful"]


def test_strict_feed_names_the_line(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id": "1", "title": "t", "body": "b", "source": "s", "more": 1}\n{"id": "2"}\n')
    with pytest.raises(Exception, match="line 2"):
        ndjson.strict(spark, str(tmp_path / "f.jsonl"), "id string, title string, body string, source string", ["id", "title", "body", "source"]).collect()
    with pytest.raises(ValueError, match="line 1"):
        ndjson.suite('{"query": "", "expected": ["a"]}')


def test_artifact_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("b.py", 1, "x", [0.5, -1.0]), ("a.py", 2, "y", [1e-300, 3.0])], "file_path string, start_line long, chunk_id string, embedding array<double>")
    digest = artifacts.write_artifact(artifacts.artifact_lines(chunks), {"repo": "r"}, str(tmp_path / "a"))
    manifest, rows = artifacts.read_artifact(spark, str(tmp_path / "a"), "file_path string, start_line long, chunk_id string, embedding string")
    back = rows.withColumn("embedding", artifacts.decode_vector("embedding")).orderBy("place").collect()
    assert manifest["checksum"] == digest and [(r.file_path, r.embedding) for r in back] == [("a.py", [1e-300, 3.0]), ("b.py", [0.5, -1.0])]


def test_snapshots(spark, tmp_path):
    for name in ("one", "two"):
        artifacts.save_snapshot(spark.range(3).withColumn("s", F.lit(name)), str(tmp_path / "k"), name)
    assert {r.s for r in artifacts.load_snapshot(spark, str(tmp_path / "k")).collect()} == {"two"}
    assert not (tmp_path / "k/snapshot=one").exists()


def test_workspace():
    listing = {"app/Gemfile": "gem 'billing'\n", "engines/billing/billing.gemspec": 's.add_dependency "rails"', "web/package.json": '{"name": "@x/web", "dependencies": {"billing": "1"}}', "x/web/package.json": "{}"}
    members = workspace.detect(listing)
    assert [(m.name, m.type) for m in members] == [("app", "rails"), ("billing", "gem"), ("web", "node"), ("web-2", "node")]
    assert workspace.links(members, listing) == [("app", "billing", "gemfile"), ("web", "billing", "package_json")]
    assert workspace.from_yaml(workspace.to_yaml(members)) == sorted(members, key=lambda m: m.path)
    assert workspace.scope(members, "@x/web, app") == ["web", "app"]
    assert workspace.settings({"top_k": "many", "min_score": 0.5}) == workspace.Settings(min_score=0.5)


def test_stream_equals_batch(spark, tmp_path):
    from siltstone.streaming import logs

    (tmp_path / "in").mkdir()
    body = [json.dumps({"event": e, "ts": f"2026-07-0{d}T10:00:00Z", "tokens_saved": d, "helpful": True}) for d in (1, 2, 3) for e in ("search", "feedback")]
    (tmp_path / "in/a.jsonl").write_text("\n".join(body[:4]) + "\n")
    (tmp_path / "in/b.jsonl").write_text("\n".join(body[4:]) + "\nbad\n")
    q = logs.daily(logs.lines(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day, r.searches, r.tokens_saved, r.helpful) for r in spark.table("days").collect()}
    log, _ = ndjson.read_log(spark, str(tmp_path / "in"))
    assert got == {(r.day, r.searches, r.tokens_saved, r.helpful) for r in metrics.daily(log).collect()}


def test_compression():
    reg = chunking.Registry()
    js = "class A {\n  m(a) { return a; }\n  n() { return 2; }\n}\n"
    assert chunking.compressed("a.js", js, "signature", reg) == "class A"
    assert chunking.compressed("a.js", js, "compact", reg) == "class A\n  m(a)\n  n()"
    assert chunking.compressed("a.txt", "\nfirst\nsecond\n", "compact", reg) == "first\n… (+1 lines)"
    assert retrieval.QUERY_BLOCK > 0


def test_scan_keeps_dot_files_and_finds_nested_rules(spark, tmp_path):
    made = {"vendor/a.py": "a", "target/b.py": "b", "coverage/c.py": "c", ".env.example": "A=", ".eslintrc.js": "x", "_under/d.py": "d", "build/no.py": "n", ".hidden/no.py": "n", "events.jsonl": "{}", "big.txt": "x" * 3_000_000,
            ".gitignore": "*.log\n/only_root.txt\nskipped/\n", "a.log": "no", "only_root.txt": "no", "sub/only_root.txt": "yes", "sub/.gitignore": "!a.log\nown.txt\n", "sub/a.log": "back", "sub/own.txt": "no", "skipped/x.py": "no", "sub/skipped/y.py": "no", "own.txt": "yes"}
    for path, body in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe")
    got = {r.file_path: (r.reason, r.content) for r in files.scan(spark, str(tmp_path)).collect()}
    read = {p for p, (why, _) in got.items() if why is None}
    assert read == {"vendor/a.py", "target/b.py", "coverage/c.py", ".env.example", ".eslintrc.js", "_under/d.py", ".gitignore", "sub/only_root.txt", "sub/.gitignore", "sub/a.log", "own.txt"}
    assert {p: why for p, (why, _) in got.items() if why} == {"events.jsonl": "skipped", "big.txt": "large", "bin.dat": "binary"}
    assert got["sub/a.log"][1] == "back" and got["big.txt"][1] is None


def test_a_batch_that_is_tried_again_replaces_itself(spark, tmp_path):
    from siltstone.streaming import logs

    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text("\n".join(json.dumps({"event": "search", "ts": "2026-07-04T10:00:00Z", "tokens_saved": 10, "savings_ratio": r}) for r in (0.25, 0.5)))
    for state in ("s1", "s2"):  # the same batch twice, as after a failure between sink and checkpoint
        logs.trends_each_trigger(logs.lines(spark, str(tmp_path / "log")), lambda: 1783245600, str(tmp_path / "sink"), str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink/events")).count() == 2
    got = {r.metric: r.current for r in spark.read.parquet(str(tmp_path / "sink/trends")).collect()}
    assert got["savings_ratio"] == 0.375


def test_trends_come_from_partials_of_all_batches(spark, tmp_path):
    """As over the whole log, though each trigger sees one file; a batch that is tried again adds nothing."""
    from siltstone.streaming import logs

    now, rng = 1783245600, random.Random(1)
    body = [json.dumps({"event": rng.choice(["search", "feedback"]), "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now - rng.randrange(16 * 86400))), "savings_ratio": rng.randrange(8) / 8, "top_score": 0.5, "result_count": rng.randrange(3), "empty": rng.random() < 0.3, "low_confidence": rng.random() < 0.5, "helpful": rng.random() < 0.5}) for _ in range(300)]
    (tmp_path / "log").mkdir()
    for i in range(3):
        (tmp_path / f"log/{i}.jsonl").write_text("\n".join(body[i::3]) + "\n")
    for state in ("s1", "s2"):
        logs.trends_each_trigger(logs.lines(spark, str(tmp_path / "log"), maxFilesPerTrigger=1), lambda: now, str(tmp_path / "sink"), str(tmp_path / state)).awaitTermination()
    log, _ = ndjson.read_log(spark, str(tmp_path / "log"))
    want = sorted(map(tuple, metrics.savings_trend(log, now).unionByName(metrics.quality_trend(log, now)).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "sink/trends")).collect())) == want
    assert len([p for p in os.listdir(tmp_path / "sink/partials") if p.startswith("epoch")]) <= 2


def test_ledger_stream_forgets_nothing_over_a_restart(spark, tmp_path):
    from siltstone.streaming import ledger

    events = [("a", i, "search", f"q{i % 4}", f"f{i % 3}.py", None, None, 5, 7) for i in range(9, 0, -1)] + [("a", 20, "decision", None, None, None, "d1", None, None), ("b", 1, "expand", None, "g.py", "c", None, None, None)]
    schema = "session string, ord long, kind string, query string, file_path string, chunk_id string, id string, tokens_saved long, served_tokens long"
    got = []
    for i, part in enumerate((events[:5], events[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))  # started again for each part
        ledger.ledger(stream, most=3, threshold=40).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda batch, _: got.extend(batch.collect())).start().awaitTermination()
    a = [r for r in got if r.session == "a"]
    assert [(r.searches, r.served_tokens, r.summarise) for r in a] == [(5, 35, False), (9, 63, True)]
    assert (a[-1].n_files, a[-1].files, a[-1].queries, a[-1].decisions) == (3, ["f0.py", "f1.py", "f2.py"], ["q1", "q2", "q3"], ["d1"])
    assert [(r.files, r.chunks) for r in got if r.session == "b"] == [(["g.py"], ["c"])]


def test_strict_reader_numbers_lines_over_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        lines = [json.dumps({"id": f"r{i}", "title": "t" * (i % 50)}) for i in range(300)]
        (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
        (tmp_path / "b.jsonl").write_text("\r\n".join([*lines[:9], "", *lines[9:20]]))
        got = ndjson.numbered(spark, str(tmp_path))
        assert got.count() == 321 and spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 4
        a = sorted((r.line, r.value) for r in got.collect() if r.file.endswith("a.jsonl"))
        b = sorted((r.line, r.value) for r in got.collect() if r.file.endswith("b.jsonl"))
        assert a == list(enumerate(lines, 1)) and b == list(enumerate([*lines[:9], "", *lines[9:20]], 1))
        (tmp_path / "a.jsonl").write_text("\n".join([*lines[:211], "{broken", *lines[211:]]))
        with pytest.raises(Exception, match="line 212"):
            ndjson.strict(spark, str(tmp_path / "a.jsonl"), "id string, title string", ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_checksum_files_of_the_file_system_are_left_out(spark, tmp_path):
    for name in ("a.crc", ".a.crc", "b.py"):
        (tmp_path / name).write_text("x")
    assert {r.file_path for r in files.scan(spark, str(tmp_path)).collect()} == {"a.crc", "b.py"}


def test_critical_values_of_t():
    from siltstone.operators import quality

    for df, want in ((1, 12.706204736), (2, 4.30265273), (10, 2.228138852), (120, 1.979930405)):
        assert abs(quality.critical(df) - want) < 1e-8
    assert abs(quality.two_sided(quality.critical(7, 0.99), 7) - 0.01) < 1e-12


def test_c_definitions_do_not_backtrack():
    import time

    start = time.time()
    chunking.code_chunks("a.c", "p** " * 3000, chunking.Registry())
    assert time.time() - start < 5
    assert [r[1:3] for r in chunking.code_chunks("a.c", "static char **names(int a) {\n  return 0;\n}\n", chunking.Registry())] == [(1, 3)]


CHUNKS = "record_id string, file_path string, start_line long, chunk_id string, content string"


def published(spark, ids):
    return spark.createDataFrame([(f"r{i}", f"r{i}", 1, f"c{i}", f"text {i}\nof\ttwo lines") for i in ids], CHUNKS)


def test_what_is_pulled_is_checked(spark, tmp_path):
    from siltstone.sources import remote

    at, rows = remote.FolderRemote(spark, str(tmp_path)), published(spark, range(20))
    assert remote.init(at, "c") and not remote.init(at, "c") and remote.status(at, "c", rows) == "absent"
    with pytest.raises(FileNotFoundError):
        remote.pull(at, "c", CHUNKS)
    done = remote.push(at, "c", rows)
    assert done["pushed"] and done["version"] == 1 and remote.status(at, "c", rows.repartition(3)) == "current" and remote.corpora(at) == ["c"]
    assert remote.push(at, "c", rows.limit(5), dry_run=True, force=True)["reason"] == "dry run"
    assert sorted(map(tuple, remote.pull(at, "c", CHUNKS).collect())) == sorted(map(tuple, rows.collect()))
    assert remote.push(at, "c", published(spark, range(25)))["pushed"] and remote.pull(at, "c", CHUNKS, version=1).count() == 20
    assert [(r.version, r.lines, r.records, r.current) for r in remote.versions(at, "c").collect()] == [(1, 20, 20, False), (2, 25, 25, True)]
    data = remote.head(at, "c")["data"]
    assert remote.verify(at, "c")["sound"]
    spark.read.text(at.path(f"{data}/lines")).limit(24).write.text(at.path(f"{data}/cut"))
    spark.read.text(at.path(f"{data}/cut")).write.mode("overwrite").text(at.path(f"{data}/lines"))
    assert not remote.verify(at, "c")["whole"] and remote.verify(at, "c", 1)["sound"]
    with pytest.raises(ValueError):
        remote.pull(at, "c", CHUNKS)
    with pytest.raises(ValueError):
        at.get("../escape")


class Overtaken:
    """A remote whose other users commit just before this one's entries."""

    def __init__(self, at, others):
        self.at, self.others = at, list(others)

    def __getattr__(self, name):
        return getattr(self.at, name)

    def create(self, key, data):
        if self.others:
            self.others.pop(0)()
        return self.at.create(key, data)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both build on the same state; the second to commit sees the first's records, and is refused or goes on from there."""
    from siltstone.sources import remote

    at = remote.FolderRemote(spark, str(tmp_path))
    remote.push(at, "c", published(spark, range(3)))
    both = Overtaken(at, [lambda: remote.push(at, "c", published(spark, range(5)))])
    done = remote.push(both, "c", published(spark, [*range(3), 9]))
    assert (done["pushed"], done["reason"], done["tries"]) == (False, "shrinks", 2) and remote.pull(at, "c", CHUNKS).count() == 5
    both = Overtaken(at, [lambda: remote.push(at, "c", published(spark, range(6)))])
    done = remote.push(both, "c", published(spark, range(8)))
    assert (done["pushed"], done["tries"], done["version"]) == (True, 2, 3) and remote.pull(at, "c", CHUNKS).count() == 8
    with pytest.raises(remote.Conflict):
        remote.push(Overtaken(at, [lambda n=n: remote.push(at, "c", published(spark, range(n))) for n in (9, 10)]), "c", published(spark, range(20)), tries=2)


def test_an_entry_that_was_passed_over_counts_as_lost(spark, tmp_path):
    """A writer whose entry was still empty when another went past it."""
    from siltstone.sources import remote

    at = remote.FolderRemote(spark, str(tmp_path))
    remote.push(at, "c", published(spark, range(3)))
    base = remote.entries(at, "c")[-1]
    assert at.create("c/log/000000000001.json", b"")  # taken, nothing in it yet
    assert [e["version"] for e in remote.entries(at, "c", waits=1)] == [0]
    done = remote.push(at, "c", published(spark, range(4)))
    assert done["version"] == 2 and done["pushed"]
    at.put("c/log/000000000001.json", json.dumps(base | {"version": 1, "base": 0}).encode())  # comes too late
    assert [e["version"] for e in remote.entries(at, "c")] == [0, 2]


def test_retired_data_goes_and_others_stays(spark, tmp_path):
    from siltstone.sources import remote

    at = remote.FolderRemote(spark, str(tmp_path))
    at.put("c/data/of-another-writer/x", b"1")
    for n in range(1, 5):
        remote.push(at, "c", published(spark, range(n)), keep=2)
    assert at.has("c/data/of-another-writer/x") and len(at.list("c/data")) == 3
    assert remote.verify(at, "c", 2)["sound"] and not at.has(remote.entries(at, "c")[0]["data"])


def test_address_depends_on_lines_and_order_alone(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(artifacts, "FAN", 4)
    rows = published(spark, range(23))
    lines = [r.value for r in artifacts.artifact_lines(rows).orderBy("place").collect()]
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    want = hashlib.sha256(level[0].encode()).hexdigest()
    assert artifacts.address(artifacts.artifact_lines(rows.repartition(7))) == artifacts.address(artifacts.artifact_lines(rows.coalesce(1))) == want
    assert artifacts.artifact_lines(rows).agg({"place": "max"}).first()[0] == 23 and len({r.place for r in artifacts.artifact_lines(rows.repartition(5)).collect()}) == 23
    assert artifacts.address(artifacts.artifact_lines(rows.limit(0))) == hashlib.sha256(b"").hexdigest()


def test_chunks_without_embedding_are_not_published(spark, tmp_path):
    from siltstone.sources import remote

    rows = spark.createDataFrame([("r", "r", 1, "c", "t", [1.0, -0.5]), ("s", "s", 1, "d", "u", [])], CHUNKS + ", embedding array<double>")
    at = remote.FolderRemote(spark, str(tmp_path))
    with pytest.raises(ValueError):
        remote.push(at, "c", rows)
    remote.push(at, "c", rows.limit(1))
    assert remote.pull(at, "c", CHUNKS + ", embedding string").first()["embedding"] == [1.0, -0.5]


def test_held_stores_follow_their_files(spark, tmp_path):
    engine = Engine(spark)
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "store/chunks"))
        first = engine.held(str(tmp_path / "store"))
        assert first["chunks"].count() == n and engine.held(str(tmp_path / "store")) is first
    engine.held.release(str(tmp_path / "store"))
    assert not engine.held.known


def test_another_embedder_can_be_given(spark):
    from pyspark.sql import functions as F

    from siltstone.functions import embed
    from siltstone.operators import retrieval

    class Lengths:
        name = "lengths"

        def column(self, texts):
            return F.array(F.length(texts).cast("double"), F.lit(1.0))

    rows = spark.createDataFrame([(0, "abc")], "ord long, content string")
    assert retrieval.embedded(rows, Lengths()).first()["counts"] == [3.0, 1.0]
    assert embed.HashEmbedder().name == "hash" and len(retrieval.embedded(rows).first()["counts"]) == 256


def test_packs_are_checked_in_three_layers():
    good = chunking.Registry()
    assert all(wrong == [] for wrong in good.validate().values())
    typo = chunking.Pack("odd", (".ODD",), lambda t: [chunking.Found(0, 99, 3, "k", "functon", "f")], lambda t: [], "sample")
    wrong = chunking.Registry([typo]).validate()["odd"]
    assert "type 'functon' is not known; did you mean 'function'?" in wrong and "a definition lies outside the sample" in wrong
    assert "no import found in the sample" in wrong and any(".ODD" in w for w in wrong)


def test_lines_move_only_when_published(spark, tmp_path, monkeypatch):
    """a status, a push of what is there and a refused push compare keys and digests; lines are dealt and written by a push that publishes them."""
    from siltstone.sources import remote

    moved = []
    lines = artifacts.artifact_lines
    monkeypatch.setattr(artifacts, "artifact_lines", lambda *a, **b: moved.append(1) or lines(*a, **b))
    at, rows = remote.FolderRemote(spark, str(tmp_path)), published(spark, range(20))
    said = [remote.push(at, "c", x)["reason"] for x in (rows, rows.repartition(3), rows.where("record_id < 'r15'"))] + [remote.status(at, "c", rows), remote.status(at, "c", published(spark, range(21)))]
    assert said == ["published", "unchanged", "shrinks", "current", "behind"] and len(moved) == 1


def test_lines_follow_their_order(spark, tmp_path):
    """places found from keys and digests are those of the lines, whatever parts they are dealt to: nulls first, equal keys by digest, edges last."""
    import hashlib

    ids = [(None, None, "c"), (None, 2, "b"), ("f", None, None), *[("f", i % 7, f"c{i % 3}") for i in range(60)], *[("g", -i, "é") for i in range(30)]]
    rows = spark.createDataFrame([(f"r{i}", *k, f"text {i % 80}") for i, k in enumerate(ids)], CHUNKS)
    edges = spark.createDataFrame([("x", "y"), ("a", "b")], "src string, dst string")
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    made = [(r.kind_, low(r.a), low(r.b), low(r.c), hashlib.sha256(r.value.encode()).digest(), r.value) for r in artifacts.artifact_rows(rows, edges).collect()]
    want = [(i + 1, m[-1]) for i, m in enumerate(sorted(made))]
    order = artifacts.line_order(rows.repartition(5), edges)
    assert order.n == len(want) and len(order.lows) > 2
    dealt = artifacts.artifact_lines(rows.repartition(3), edges, order)
    assert sorted(map(tuple, dealt.collect())) == want == sorted(map(tuple, artifacts.artifact_lines(rows, edges).collect()))
    assert sorted((p, bytes(s)) for p, s in order.places.collect()) == [(p, hashlib.sha256(v.encode()).digest()) for p, v in want]
    root = artifacts.write_artifact(dealt, {}, str(tmp_path / "a"), artifacts.order_address(order), order.n)
    assert artifacts.check_artifact(spark, str(tmp_path / "a"))["sound"] and root == artifacts.address(dealt)
