"""The public verbs over a session: index a tree, search it, ask documents, remember, report, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import chunking, redact, text
from siltstone.operators import inverted, metrics, quality, reports, retrieval
from siltstone.plans.cache import Held
from siltstone.sources import artifacts, files, ndjson, remote

RECORDS = "id string, title string, body string, source string, url string, state string, state_reason string, updated_at string, labels array<string>, `group` string, links array<string>"


class Engine:
    def __init__(self, spark: SparkSession, registry: chunking.Registry | None = None):
        self.spark, self.registry = spark, registry or chunking.Registry()
        self.held = Held(spark, lambda path: artifacts.load_store(spark, path))

    # ingest
    def index(self, root: str, rules: list = (), protect: bool = True) -> dict[str, DataFrame]:
        """chunks (with counts), imports, file_tokens of a tree; secrets are gone before anything is derived."""
        texts = files.read_texts(files.scan(self.spark, root, rules, protect))
        chunks = retrieval.embedded(chunking.chunk_files(texts, self.registry))
        return {"chunks": chunks, "imports": chunking.file_imports(texts, self.registry), "file_tokens": texts.select("file_path", text.token_count(F.col("content")).alias("tokens"))}

    def save(self, tables: dict[str, DataFrame], path: str) -> None:
        artifacts.save_store(tables, path)

    def load(self, path: str, members: list[str] | None = None) -> dict[str, DataFrame]:
        return artifacts.load_store(self.spark, path, members)

    def edges(self, tables: dict[str, DataFrame]) -> DataFrame:
        return retrieval.resolve_imports(tables["imports"].select("file_path", "module"), tables["chunks"].select("file_path").distinct())

    def ingest(self, feed: str, manifest: dict | None = None, budget: int = chunking.SECTION_BUDGET) -> DataFrame:
        """Sections of a feed of records, redacted, with their record's facets."""
        if manifest:
            ndjson.verify_manifest(self.spark, feed, manifest["records"], manifest["sha256"])
        records = ndjson.strict(self.spark, feed, RECORDS, ["id", "title", "body", "source"])
        clean = {c: redact.redacted(F.col(c)) for c in ("title", "body")}
        records = records.withColumns(clean)
        docs = records.select(F.concat("id", F.lit(".md")).alias("file_path"), text.render_document(F.col("title"), F.col("body")).alias("content"))
        chunks = chunking.chunk_files(docs, self.registry, budget).withColumn("record_id", F.regexp_replace("file_path", r"\.md$", "")).withColumn("file_path", F.col("record_id"))
        facets = records.select(F.col("id").alias("record_id"), "title", "source", "url", "state", "state_reason", "updated_at", "labels", "links", F.col("group"))
        return retrieval.embedded(chunks.join(facets, "record_id"))

    # queries
    def queries(self, *asked: str, k: int = 10) -> DataFrame:
        return self.spark.createDataFrame([(i, q, k) for i, q in enumerate(asked)], "q_id long, query string, k long")

    def build_index(self, chunks: DataFrame, path: str) -> inverted.Index:
        """Postings and vectors of chunks below path, for the searches that take an index."""
        return inverted.build(chunks, path)

    def open_index(self, path: str) -> inverted.Index:
        return inverted.Index(self.spark, path)

    def search(self, tables: dict[str, DataFrame], queries: DataFrame, graph: bool = True, index: inverted.Index | None = None) -> DataFrame:
        return retrieval.search(tables["chunks"], queries, self.edges(tables) if graph else None, index)

    def federated_search(self, members: DataFrame, queries: DataFrame, links: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        return retrieval.federated(members, queries, links, edges)

    def ask(self, chunks: DataFrame, queries: DataFrame, floor: float = 0.30, index: inverted.Index | None = None) -> DataFrame:
        """index: of retrieval.live(chunks)."""
        found = retrieval.search_knowledge(chunks.drop("counts"), queries, floor, index=index)
        return found.withColumn("provenance", text.provenance(F.col("title"), F.col("state"), F.col("updated_at"), F.col("url")))

    def recall(self, entries: DataFrame, queries: DataFrame, index: inverted.Index | None = None) -> DataFrame:
        return retrieval.recall(entries, queries, index=index)

    def context_search(self, tables: dict[str, DataFrame], documents: DataFrame | None, queries: DataFrame, source: str = "both", limit: int | None = None) -> DataFrame:
        """Code, documents or both in one order, cut to a budget of tokens if one is given."""
        if source == "code" or documents is None:
            found = self.search(tables, queries)
        elif source == "knowledge":
            found = self.ask(documents, queries)
        else:
            k = queries.agg(F.max("k")).first()[0]
            found = retrieval.blend(self.search(tables, queries), self.ask(documents, queries), k)
        return reports.budgeted(found, limit) if limit else found

    def expand_chunk(self, tables: dict[str, DataFrame], chunk_id: str, scope: str = "chunk") -> DataFrame:
        """A chunk, all of its file, or the chunks next to it in its file."""
        c = tables["chunks"]
        own = c.where(F.col("chunk_id") == chunk_id)
        if scope == "chunk":
            return own
        mates = c.join(own.select("file_path").distinct(), "file_path", "left_semi").orderBy("start_line", "chunk_id")
        if scope == "file":
            return mates
        spot = own.agg(F.min("start_line").alias("lo"), F.max("end_line").alias("hi")).first()
        near = mates.where((F.col("end_line") < spot["lo"]) | (F.col("start_line") > spot["hi"]))
        gap = F.least(F.abs(F.col("start_line") - spot["hi"]), F.abs(F.lit(spot["lo"]) - F.col("end_line")))
        return near.orderBy(gap, "start_line").limit(2)

    def related_context(self, tables: dict[str, DataFrame], path: str, k: int = 10) -> DataFrame:
        return retrieval.related(tables["chunks"], self.edges(tables), path, k)

    # decisions, feedback, reports
    def remember(self, path: str, held: DataFrame, decision: str, tags: list[str], area: str | None, ts: str) -> DataFrame:
        new = self.spark.createDataFrame([(redact.redact_text(decision), tags, redact.redact_text(area) if area else None, ts)], "text string, tags array<string>, area string, ts string")
        return artifacts.append_decisions(self.spark, path, new.withColumn("id", text.decision_id(F.col("text"))), held)

    def record_feedback(self, log: str, target: str, helpful: bool, note: str, ts: str, id_: str) -> None:
        artifacts.append_event(self.spark, log, {"event": "feedback", "ts": ts, "id": id_, "target_id": target, "helpful": helpful, "note": note})

    def report(self, log: DataFrame, now: int, price: float) -> dict[str, DataFrame]:
        return {"totals": metrics.totals(log, price), "by_source": metrics.by_source(log), "savings": metrics.savings_trend(log, now), "quality": metrics.quality_trend(log, now), "daily": metrics.daily(log), "recent": metrics.recent(log), "freshness": metrics.freshness(log), "secrets": metrics.secret_safety(log)}

    def relevance(self, tables: dict[str, DataFrame], cases: list[dict], backends: tuple[str, ...] = ("bm25", "vector", "hybrid")) -> DataFrame:
        """Scores of each case and backend."""
        asked = self.spark.createDataFrame([(c["id"], c["query"], c.get("k") or 10, c["expected"]) for c in cases], "q_id string, query string, k long, expected array<string>")
        wanted = asked.select("q_id", F.explode("expected").alias("a")).select("q_id", quality.anchors(F.col("a")).alias("anchor"))
        out = None
        for name in backends:
            found = retrieval.by_backend(name, tables["chunks"], asked, self.edges(tables)).select("q_id", "rank", "ord").join(tables["chunks"], "ord")
            own = quality.scores(found, wanted, asked).withColumn("backend", F.lit(name))
            out = own if out is None else out.unionByName(own)
        return out

    def doctor(self, tables: dict[str, DataFrame]) -> DataFrame:
        return quality.doctor(tables["chunks"])

    def ask_suite(self, chunks: DataFrame, cases: list[dict], floor: float = 0.30, share: float | None = None) -> DataFrame:
        """One row: means of a suite of questions (id, query, k, expect: records) and whether it passes."""
        asked = self.spark.createDataFrame([(c["id"], c["query"], c.get("k") or 5, c["expect"]) for c in cases], "q_id string, query string, k long, expect array<string>")
        return reports.suite_gate(reports.suite_scores(self.ask(chunks, asked).select("q_id", "rank", "record_id"), asked), share)

    def audit(self, tables: dict[str, DataFrame], files_: DataFrame) -> DataFrame:
        """What doctor looks at, and what a store has that its files or its redaction no longer bear out."""
        return quality.doctor(tables["chunks"]).crossJoin(reports.store_audit(tables["chunks"], files_, redact.redacted(F.col("content")) != F.col("content")))  # a row each

    def push(self, root: str, corpus: str, chunks: DataFrame, **options) -> dict:
        return remote.push(remote.FolderRemote(self.spark, root), corpus, chunks, **options)

    def pull(self, root: str, corpus: str, schema: str, version: int | None = None) -> DataFrame:
        return remote.pull(remote.FolderRemote(self.spark, root), corpus, schema, version)

    def versions(self, root: str, corpus: str) -> DataFrame:
        return remote.versions(remote.FolderRemote(self.spark, root), corpus)

    def verify(self, root: str, corpus: str, version: int | None = None) -> dict:
        return remote.verify(remote.FolderRemote(self.spark, root), corpus, version)
