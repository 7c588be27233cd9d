"""The verbs of the engine over small tables."""

import hashlib
import json

import pytest

from siltstone.plans.engine import Engine


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "auth.py").write_text("import store\n\ndef login(user):\n    return store.find(user)\n\ndef logout(user):\n    return None\n")
    (root / "store.py").write_text("def find(name):\n    return name\n")
    (root / "notes.md").write_text("# Sessions\n\nLogin opens a session.\n\n# Storage\n\nRecords are kept by name.\n")
    engine = Engine(spark)
    tables = engine.index(str(root))
    path = str(tmp_path_factory.mktemp("store"))
    engine.save(tables, path)
    return engine, engine.load(path)


def feed(tmp_path):
    rows = [{"id": f"r{i}", "title": t, "body": b, "source": "forge", "url": f"https://forge.example/{i}", "state": "closed", "state_reason": why, "updated_at": f"2026-01-0{i}T00:00:00Z", "labels": [], "group": "g", "links": links}
            for i, (t, b, why, links) in enumerate([("Login fails", "login fails after logout", None, ["https://forge.example/g/p/pull/3"]), ("Slow storage", "records are slow", None, []), ("Old login", "login was odd", "wontfix", [])], 1)]
    body = "\n".join(map(json.dumps, rows)) + "\n"
    (tmp_path / "feed.jsonl").write_text(body)
    return str(tmp_path / "feed.jsonl"), {"records": 3, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def test_search_with_and_without_an_index(store, tmp_path):
    engine, tables = store
    asked = engine.queries("login user", "find name", k=2)
    index = engine.build_index(tables["chunks"], str(tmp_path / "index"))
    shape = lambda df: sorted((r.q_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = shape(engine.search(tables, asked))
    assert want and shape(engine.search(tables, asked, index=index)) == want == shape(engine.search(tables, asked, index=engine.open_index(str(tmp_path / "index"))))


def test_ask_and_context_search(store, tmp_path):
    engine, tables = store
    path, manifest = feed(tmp_path)
    documents = engine.ingest(path, manifest)
    with pytest.raises(ValueError):
        engine.ingest(path, manifest | {"records": 4})
    found = engine.ask(documents, engine.queries("login", k=3)).orderBy("rank").collect()
    assert [r.record_id for r in found] == ["r1"] and found[0].provenance.startswith("[knowledge] Login fails")
    suite = engine.ask_suite(documents, [{"id": "a", "query": "login", "expect": ["r1"]}, {"id": "b", "query": "slow records", "expect": ["r2"]}]).first()
    assert suite["mrr"] == 1.0
    both = engine.context_search(tables, documents, engine.queries("login", k=3)).collect()
    assert {r.origin for r in both} == {0, 1}
    assert engine.context_search(tables, documents, engine.queries("login"), source="knowledge").count() == 1
    assert engine.context_search(tables, None, engine.queries("login"), limit=1).count() == 1


def test_expand_relevance_and_audit(store):
    engine, tables = store
    chunk = tables["chunks"].where("file_path = 'auth.py' and start_line = 3").first()
    assert engine.expand_chunk(tables, chunk.chunk_id).count() == 1
    assert {r.file_path for r in engine.expand_chunk(tables, chunk.chunk_id, "file").collect()} == {"auth.py"}
    assert [r.start_line for r in engine.expand_chunk(tables, chunk.chunk_id, "near").collect()][:1] == [6]
    scores = engine.relevance(tables, [{"id": "c", "query": "find name", "expected": ["store.py"]}]).collect()
    assert {r.backend for r in scores} == {"bm25", "vector", "hybrid"} and all(r.found == 1 for r in scores)
    audit = engine.audit(tables, tables["chunks"].select("file_path").distinct()).first()
    assert audit["chunks"] == tables["chunks"].count()
