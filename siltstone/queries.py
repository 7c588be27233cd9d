"""Registered queries over the driver's tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import embed, redact, text
from siltstone.operators import metrics, quality, retrieval
from siltstone.plans import indexes, tables
from siltstone.plans.tables import NOW, PRICE, corpus, log, questions, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOWER = f"translate({{}}, '{text.UPPER}', '{text.LOWER}')"
LOW = lambda x: LOWER.format(x)
TOKENS = lambda x: f"regexp_extract_all({LOW(x)}, '[a-z0-9_]+')"
COUNT = lambda x: f"greatest(1, strlen({x}) // 4)::BIGINT"
KEY = lambda x: f"round(({x})::DOUBLE * 1e6)::BIGINT"
SIX = lambda x: f"(round(({x})::DOUBLE * 1e6) / 1e6)"
CORPUS = """corpus AS (SELECT doc_id AS ord, lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, source || '/' || lang || '.txt' AS file_path, 1::BIGINT AS start_line,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS end_line, lang AS language, source AS member, coalesce(text, '') AS content FROM documents)"""
ASKED = f"""asked AS (SELECT item_id AS q_id, coalesce(text, '') AS query, 10::BIGINT AS k, list_distinct({TOKENS("coalesce(text, '')")}) AS words FROM benchmark),
q AS (SELECT *, list_filter(regexp_split_to_array({LOW("trim(query)")}, '\\s+'), lambda t: contains(t, '.')) AS hints,
  CASE WHEN list_has_any(words, ['function', 'class', 'method', 'def']) OR regexp_matches({LOW("query")}, '\\.(py|js|jsx|ts|go|rb|rs|java)([^a-z0-9_]|$)') OR contains({LOW("query")}, 'where is ') OR contains({LOW("query")}, ' defined')
    OR (contains({LOW("query")}, 'find ') AND contains(substr({LOW("query")}, position('find ' IN {LOW("query")})), ' function')) THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM asked WHERE len(words) > 0)"""
BM25 = f"""tok AS (SELECT ord, unnest(t) AS term, len(t) AS doc_len FROM (SELECT ord, {TOKENS("content")} AS t FROM corpus)),
tf AS (SELECT ord, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM tok GROUP BY ord, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stat AS (SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, (SELECT avg(len({TOKENS("content")})) FROM corpus) AS avg_len),
part AS (SELECT q_id, ord, tf.term, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (doc_len / avg_len))) AS part
  FROM (SELECT q_id, unnest(words) AS term FROM q) w JOIN tf USING (term) JOIN df USING (term), stat),
bm AS (SELECT q_id, ord, sum(part ORDER BY term) AS bm25 FROM part GROUP BY q_id, ord),
fr AS (SELECT q_id, ord, chunk_id, bm25, row_number() OVER (PARTITION BY q_id ORDER BY {KEY("bm25")} DESC, chunk_id, ord) - 1 AS frank FROM bm JOIN corpus USING (ord) WHERE {KEY("bm25")} > 0),
kw AS (SELECT fr.* FROM fr JOIN q USING (q_id) WHERE frank < 3 * k)"""
HASH = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(term, ''), lambda c: ascii(c)::HUGEINT)), lambda a, e: (xor(a, e) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
VECTORS = f"""qtok AS (SELECT q_id, unnest({TOKENS("query")}) AS term FROM q), dtok AS (SELECT ord, unnest({TOKENS("content")}) AS term FROM corpus),
hashed AS (SELECT term, {HASH} AS h FROM (SELECT DISTINCT term FROM (SELECT term FROM dtok UNION ALL SELECT term FROM qtok))),
cell AS (SELECT term, h % 256 AS bucket, CASE WHEN h >= 9223372036854775808::HUGEINT THEN -1 ELSE 1 END AS sign FROM hashed),
dv AS (SELECT ord, bucket, sum(sign)::DOUBLE AS v FROM dtok JOIN cell USING (term) GROUP BY ord, bucket), qv AS (SELECT q_id, bucket, sum(sign)::DOUBLE AS v FROM qtok JOIN cell USING (term) GROUP BY q_id, bucket),
dn AS (SELECT ord, sqrt(sum(v * v)) AS n FROM dv GROUP BY ord), qn AS (SELECT q_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY q_id),
dots AS (SELECT q_id, ord, sum(dv.v * qv.v) AS d FROM dv JOIN qv USING (bucket) GROUP BY q_id, ord),
cosines AS (SELECT q.q_id, corpus.ord, chunk_id, CASE WHEN dn.n * qn.n > 0 THEN coalesce(d, 0) / (dn.n * qn.n) ELSE 0 END::DOUBLE AS cosine FROM q CROSS JOIN corpus LEFT JOIN dots USING (q_id, ord) LEFT JOIN dn USING (ord) LEFT JOIN qn USING (q_id)),
vr AS (SELECT q_id, ord, chunk_id, cosine, row_number() OVER (PARTITION BY q_id ORDER BY {KEY("cosine")} DESC, chunk_id, ord) - 1 AS vrank FROM cosines), ve AS (SELECT vr.* FROM vr JOIN q USING (q_id) WHERE vrank < greatest(3 * k, 1))"""
FUSED = """cand AS (SELECT q_id, ord, vrank, frank, coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(weight * (1.0::DOUBLE / (60 + frank)), 0) AS fused FROM ve FULL OUTER JOIN kw USING (q_id, ord) JOIN q USING (q_id)),
rel AS (SELECT *, fused / max(fused) OVER (PARTITION BY q_id) AS relative FROM cand)"""
HYBRID = f"""{CORPUS}, {ASKED}, {BM25}, {VECTORS}, {FUSED},
sc AS (SELECT rel.q_id, rel.ord, c.chunk_id, file_path, start_line, end_line, content, member, k, cosine,
  (0.5::DOUBLE * (0.5::DOUBLE * (1.0::DOUBLE - least(greatest((1.0::DOUBLE - cosine) / 2.0::DOUBLE, 0), 1)) + 0.4::DOUBLE * greatest(0, 1.0::DOUBLE - (CASE WHEN len(list_filter(words, lambda t: contains({LOW("content")}, t))) > 0
    OR len(list_filter(hints, lambda t: contains({LOW("file_path")}, t))) > 0 THEN 0 ELSE 2 END)::DOUBLE / 5)) + 0.5::DOUBLE * relative)
  * CASE WHEN regexp_matches({LOW("file_path")}, 'tests/|test_|docs/|spec|plan') THEN 0.8::DOUBLE ELSE 1 END AS score
  FROM rel JOIN corpus c USING (ord) JOIN cosines USING (q_id, ord) JOIN q USING (q_id)),
cap AS (SELECT *, row_number() OVER (PARTITION BY q_id, file_path ORDER BY {KEY("score")} DESC, chunk_id, ord) AS nth FROM sc),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {KEY("score")} DESC, chunk_id, ord) AS rank FROM cap WHERE nth <= 3) WHERE rank <= k)"""
LOG = f"""log AS (SELECT event_id AS ord, CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'search' WHEN event_type = 'signup' THEN 'feedback' WHEN event_type = 'error' THEN 'index' ELSE 'unknown' END AS kind,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, floor(epoch(ts))::BIGINT AS secs, event_id::VARCHAR AS id, CASE WHEN user_id % 3 = 0 THEN 'mcp' ELSE 'cli' END AS source, n % 5 AS result_count, n + 100 AS baseline_tokens, n AS tokens_saved,
  n::DOUBLE / (n + 100) AS savings_ratio, (n % 97)::DOUBLE / 100 AS top_score, n % 5 = 0 AS empty, n % 97 < 30 AS low_confidence, value AS latency_ms, (event_id - 1 - n % 7)::VARCHAR AS target_id, n % 2 = 0 AS helpful, n + 1 AS files_indexed, n * 3 AS chunks,
  n % 4 AS sensitive_skipped, 'query ' || n AS query, 'package' || (user_id % 11) AS package FROM (SELECT *, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS n FROM events))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text and identities


@query(f"WITH {CORPUS} SELECT ord, len({TOKENS('content')})::BIGINT AS n_tokens, len(list_distinct({TOKENS('content')}))::BIGINT AS n_terms, {COUNT('content')} AS token_count, end_line FROM corpus")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("content"))
    return corpus(spark, sf_dir).select("ord", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"), text.token_count(F.col("content")).alias("token_count"), "end_line")


@query(f"WITH {CORPUS} SELECT ord, left(sha256(encode(file_path || ':' || start_line || ':' || end_line || ':') || encode(content)[1:100]), 16) AS id FROM corpus")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("ord", text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"))


@query(f"WITH t AS (SELECT DISTINCT unnest({TOKENS('text')}) AS term FROM benchmark), h AS (SELECT term, {HASH} AS h FROM t) SELECT term, (h // 4294967296)::BIGINT AS hi, (h % 4294967296)::BIGINT AS lo FROM h")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", embed.fnv1a_limbs(F.col("term")).alias("h")).select("term", "h.hi", "h.lo")


@query(f"""WITH {CORPUS}, dtok AS (SELECT ord, unnest({TOKENS('content')}) AS term FROM corpus), hashed AS (SELECT term, {HASH} AS h FROM (SELECT DISTINCT term FROM dtok)),
cell AS (SELECT term, h % 256 AS bucket, CASE WHEN h >= 9223372036854775808::HUGEINT THEN -1 ELSE 1 END AS sign FROM hashed), dv AS (SELECT ord, bucket, sum(sign) AS v FROM dtok JOIN cell USING (term) GROUP BY ord, bucket),
s AS (SELECT ord, sum(v * v) AS squares, sum(v * (bucket + 1)) AS weighted, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS filled FROM dv GROUP BY ord)
SELECT ord, coalesce(squares, 0)::BIGINT AS squares, coalesce(weighted, 0)::BIGINT AS weighted, coalesce(filled, 0)::BIGINT AS filled FROM corpus LEFT JOIN s USING (ord)""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.embedded(corpus(spark, sf_dir)).select("ord", "counts")
    total = lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + x).cast("long")
    return c.select("ord", total(F.transform("counts", lambda x: x * x)).alias("squares"), total(F.transform("counts", lambda x, i: x * (i + 1))).alias("weighted"), F.size(F.filter("counts", lambda x: x != 0)).cast("long").alias("filled"))


@query(f"""SELECT conv_id, turn, role, {LOW('t')} LIKE '%.%' AS dotted, list_has_any({TOKENS('t')}, ['function', 'class', 'method', 'def']) OR regexp_matches({LOW('t')}, '\\.(py|js|jsx|ts|go|rb|rs|java)([^a-z0-9_]|$)') OR contains({LOW('t')}, 'where is ')
OR contains({LOW('t')}, ' defined') OR (contains({LOW('t')}, 'find ') AND contains(substr({LOW('t')}, position('find ' IN {LOW('t')})), ' function')) AS lookup FROM (SELECT *, coalesce(text, '') AS t FROM conversations)""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.contains(t, F.lit(".")).alias("dotted"), text.is_lookup(t).alias("lookup"))


@query(f"SELECT page_id, regexp_matches({LOW('url')}, 'tests/|test_|docs/|spec|plan') AS penalised, nullif({LOW(chr(39) * 0 + 'regexp_extract(url, ' + chr(39) + '[^/](\\.[^./]+)$' + chr(39) + ', 1)')}, '') AS extension FROM pages")
def path_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.penalised(F.col("url")).alias("penalised"), text.extension(F.col("url")).alias("extension"))


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') AS flat, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, left(sha256(flat), 16) AS decision, CASE WHEN length(trim(flat)) > 60 THEN left(trim(flat), 60) || '…' ELSE trim(flat) END AS label FROM t""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").fillna("", ["text"]).select("doc_id", text.decision_id(F.col("text")).alias("decision"), text.short_label(F.col("text")).alias("label"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS secs, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = text.iso_seconds(F.col("ts"))
    return log(spark, sf_dir).select(F.col("ord").alias("event_id"), secs.alias("secs"), text.utc_day(secs).alias("day"))


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10)) AS lines FROM documents), f AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: trim(x) <> ''), true) AS pos FROM l)
SELECT doc_id, CASE WHEN pos IS NULL OR pos = 0 THEN '' WHEN len(lines) > pos THEN list_extract(lines, pos) || chr(10) || '… (+' || (len(lines) - pos) || ' lines)' ELSE list_extract(lines, pos) END AS compressed FROM f""")
def compress_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.coalesce("text", F.lit(""))).alias("compressed"))


@query("""SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)\\b(password|passwd|secret[_-]?key|secret|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key|token)\\b(\\s*[:=]\\s*)"([0-9a-f]{40})"', '\\1\\2"[REDACTED:SECRET]"', 'g') AS redacted FROM documents""")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.redacted(F.coalesce("text", F.lit(""))).alias("redacted"))


@query(f"""SELECT page_id, {LOW('n')} IN ({', '.join(repr(x) for x in redact.SENSITIVE_NAMES)}) OR regexp_matches({LOW('n')}, '^.+\\.({'|'.join(redact.SENSITIVE_EXTENSIONS)})$')
OR (regexp_matches({LOW('n')}, '^\\.env(\\..*)?$') AND NOT regexp_matches({LOW('n')}, '(\\.example|\\.sample|\\.template|\\.dist)$')) AS sensitive FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)""")
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", redact.sensitive(F.regexp_extract("url", "[^/]*$", 0)).alias("sensitive"))


# --- retrieval


@query(f"WITH {CORPUS}, tok AS (SELECT ord, unnest({TOKENS('content')}) AS term FROM corpus) SELECT term, count(DISTINCT ord)::BIGINT AS df, count(*)::BIGINT AS tf FROM tok GROUP BY term")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(corpus(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {CORPUS}, {ASKED}, {BM25} SELECT term, df::BIGINT AS df, tf::BIGINT AS tf, most::INT AS most, least::INT AS least FROM (SELECT term, count(*) AS df, sum(tf) AS tf, max(tf) AS most, min(doc_len) AS least FROM tf GROUP BY term)")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the postings hold of each term: chunks, occurrences, and the bounds of its blocks."""
    return indexes.words(spark, sf_dir).term_totals()


@query(f"WITH {CORPUS} SELECT ord, chunk_id, len({TOKENS('content')})::BIGINT AS n_tokens, row_number() OVER (ORDER BY chunk_id, ord) - 1 AS place FROM corpus")
def index_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the index in the order of their places."""
    return indexes.words(spark, sf_dir).places()


@query(f"WITH {CORPUS}, {ASKED}, {BM25} SELECT q_id, ord, frank, {SIX('bm25')} AS bm25 FROM kw")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_ranked(None, questions(spark, sf_dir), index=indexes.words(spark, sf_dir)).select("q_id", "ord", F.col("frank").cast("long").alias("frank"), text.rounded(F.col("bm25")).alias("bm25"))


@query(f"WITH {CORPUS}, {ASKED}, {VECTORS} SELECT q_id, ord, vrank, {SIX('cosine')} AS cosine FROM ve")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_ranked(None, questions(spark, sf_dir), index=indexes.documents(spark, sf_dir)).select("q_id", "ord", F.col("vrank").cast("long").alias("vrank"), text.rounded(F.col("cosine")).alias("cosine"))


@query(f"""WITH q AS (SELECT vec_id AS q_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q_id, vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {KEY('s')} DESC, lpad(vec_id::VARCHAR, 12, '0')) AS rank FROM s) SELECT q_id, vec_id, rank FROM r WHERE rank <= 10""")
def embeddings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select("vec_id", "embedding").collect()  # the stated query set
    rows = e.select(F.col("vec_id").alias("ord"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("counts"))
    blocks = [asked[at : at + retrieval.QUERY_BLOCK] for at in range(0, max(len(asked), 1), retrieval.QUERY_BLOCK)]
    near = reduce(DataFrame.unionByName, [retrieval.nearest(rows, [(r["vec_id"], 10, r["embedding"]) for r in block], hashed=False) for block in blocks])
    order = Window.partitionBy("q_id").orderBy(text.score_key(F.col("cosine")).desc(), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("q_id", F.col("ord").alias("vec_id"), "rank")


@query(f"WITH {CORPUS}, {ASKED}, {BM25}, {VECTORS}, {FUSED} SELECT q_id, ord, vrank, frank, {SIX('fused')} AS fused, {SIX('relative')} AS relative FROM rel")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.candidates(corpus(spark, sf_dir), questions(spark, sf_dir), index=indexes.documents(spark, sf_dir))
    return c.select("q_id", "ord", F.col("vrank").cast("long").alias("vrank"), F.col("frank").cast("long").alias("frank"), text.rounded(F.col("fused")).alias("fused"), text.rounded(F.col("relative")).alias("relative"))


@query(f"WITH {HYBRID} SELECT q_id, rank, chunk_id, file_path, {SIX('score')} AS score FROM hy")
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked(corpus(spark, sf_dir), questions(spark, sf_dir), index=indexes.documents(spark, sf_dir)).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "file_path", text.rounded(F.col("score")).alias("score"))


def file_edges(c: DataFrame) -> DataFrame:
    """A file imports that of the next source in its language."""
    files = c.select("file_path", "member", "language").distinct().withColumn("n", F.regexp_extract("member", r"\d+", 0).cast("int"))
    a, b = files.select(F.col("file_path").alias("src"), "language", (F.col("n") + 1).alias("n")), files.select(F.col("file_path").alias("dst"), "language", "n")
    return a.join(b, ["language", "n"]).select("src", "dst")


EDGES = """files AS (SELECT DISTINCT file_path, member, language, regexp_extract(member, '[0-9]+')::INT AS n FROM corpus), edge AS (SELECT a.file_path AS src, b.file_path AS dst FROM files a JOIN files b ON a.language = b.language AND b.n = a.n + 1),
near AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge)"""
BONUS = f"""tops AS (SELECT q_id, file_path, min(rank) AS pos FROM hy WHERE rank <= 3 GROUP BY q_id, file_path),
seen AS (SELECT q_id, dst, min((pos, dst)) AS seen FROM tops JOIN near ON file_path = src WHERE (q_id, dst) NOT IN (SELECT (q_id, file_path) FROM hy) GROUP BY q_id, dst),
more AS (SELECT * FROM (SELECT q_id, dst, row_number() OVER (PARTITION BY q_id ORDER BY seen) AS nth FROM seen) WHERE nth <= 2),
bonus AS (SELECT * FROM (SELECT more.q_id, nth, c.chunk_id, c.file_path, cosine, row_number() OVER (PARTITION BY more.q_id, nth ORDER BY {KEY('cosine')} DESC, c.chunk_id, c.ord) AS i FROM more JOIN corpus c ON c.file_path = dst JOIN cosines x ON x.q_id = more.q_id AND x.ord = c.ord) WHERE i <= 2)"""


@query(f"""WITH {HYBRID}, {EDGES}, {BONUS}
SELECT q_id, rank, chunk_id, file_path, {SIX('score')} AS score FROM hy UNION ALL
SELECT q_id, (SELECT max(rank) FROM hy WHERE hy.q_id = bonus.q_id) + row_number() OVER (PARTITION BY q_id ORDER BY nth, i) AS rank, chunk_id, file_path, {SIX('greatest(0, cosine) * 0.85::DOUBLE')} AS score FROM bonus""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return retrieval.search(c, questions(spark, sf_dir), file_edges(c), indexes.documents(spark, sf_dir)).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "file_path", text.rounded(F.col("score")).alias("score"))


@query(f"WITH {CORPUS}, {EDGES} SELECT src, dst FROM near")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.neighbours(file_edges(corpus(spark, sf_dir)))


@query("""WITH f AS (SELECT n_name || '.py' AS file_path FROM nation UNION SELECT s_name || '.js' FROM supplier), i AS (SELECT DISTINCT s_name || '.js' AS file_path, n_name AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT s_name || '.js', right(n_name, 3) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT i.file_path, module, min(f.file_path) AS dst FROM i JOIN f ON regexp_replace(f.file_path, '\\.[^.]*$', '') = module GROUP BY ALL),
l AS (SELECT i.file_path, i.module, min(f.file_path) AS dst FROM i JOIN f ON ends_with(f.file_path, i.module || '.py') OR ends_with(f.file_path, i.module || '.js') WHERE (i.file_path, i.module) NOT IN (SELECT (file_path, module) FROM e) GROUP BY ALL)
SELECT DISTINCT file_path AS src, dst FROM (SELECT * FROM e UNION ALL SELECT * FROM l) WHERE file_path <> dst""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    files = n.select(F.concat("n_name", F.lit(".py")).alias("file_path")).union(s.select(F.concat("s_name", F.lit(".js"))))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat("s_name", F.lit(".js")).alias("file_path"), "n_name")
    imports = both.select("file_path", F.explode(F.array("n_name", F.right("n_name", F.lit(3)))).alias("module")).distinct()
    return retrieval.resolve_imports(imports, files)


MEMBERS = HYBRID.replace("source || '/' || lang || '.txt' AS file_path", "source || '/' || source || '/' || lang || '.txt' AS file_path")


@query(f"""WITH {MEMBERS}, links AS (SELECT DISTINCT a.member AS src, b.member AS dst FROM (SELECT DISTINCT member, regexp_extract(member, '[0-9]+')::INT AS n FROM corpus) a JOIN (SELECT DISTINCT member, regexp_extract(member, '[0-9]+')::INT AS n FROM corpus) b ON b.n = a.n + 1),
tops AS (SELECT q_id, member, min(rank) AS pos FROM hy WHERE rank <= 3 GROUP BY q_id, member),
seen AS (SELECT q_id, dst, min((pos, dst)) AS seen FROM tops JOIN links ON member = src WHERE (q_id, dst) NOT IN (SELECT (q_id, member) FROM hy) GROUP BY q_id, dst),
more AS (SELECT * FROM (SELECT q_id, dst, row_number() OVER (PARTITION BY q_id ORDER BY seen) AS nth FROM seen) WHERE nth <= 2),
bonus AS (SELECT * FROM (SELECT more.q_id, nth, c.chunk_id, c.member, cosine, row_number() OVER (PARTITION BY more.q_id, nth ORDER BY {KEY('cosine')} DESC, c.chunk_id, c.ord) AS i FROM more JOIN corpus c ON c.member = dst JOIN cosines x ON x.q_id = more.q_id AND x.ord = c.ord) WHERE i <= 2)
SELECT q_id, rank, chunk_id, member, {SIX('score')} AS score FROM hy UNION ALL
SELECT q_id, (SELECT max(rank) FROM hy WHERE hy.q_id = bonus.q_id) + row_number() OVER (PARTITION BY q_id ORDER BY nth, i) AS rank, chunk_id, member, {SIX('greatest(0, cosine) * 0.85::DOUBLE')} AS score FROM bonus""")
def federated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    names = c.select("member").distinct().withColumn("n", F.regexp_extract("member", r"\d+", 0).cast("int"))
    links = names.select(F.col("member").alias("src"), (F.col("n") + 1).alias("n")).join(names.select(F.col("member").alias("dst"), "n"), "n").select("src", "dst")
    return retrieval.federated(c, questions(spark, sf_dir), links).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "member", text.rounded(F.col("score")).alias("score"))


@query(f"WITH {CORPUS} SELECT member, count(DISTINCT file_path) AS files, count(*) AS chunks, sum({COUNT('content')})::BIGINT AS tokens FROM corpus GROUP BY member")
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("member").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum(text.token_count(F.col("content"))).alias("tokens"))


WIDE = HYBRID.replace("10::BIGINT AS k", "(SELECT greatest(count(*), 10) FROM corpus)::BIGINT AS k").replace(f"{CORPUS}, ", "")
KNOWN = CORPUS.replace("corpus AS", "known AS").replace("source || '/' || lang || '.txt' AS file_path", "lpad(doc_id::VARCHAR, 12, '0') AS file_path").replace("lang AS language", "lang AS language, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'wontfix' END AS state_reason, doc_id % 3 = 0 AS merged, lpad((doc_id % 5)::VARCHAR, 2, '0') AS updated_at")


@query(f"""WITH {KNOWN}, corpus AS (SELECT * FROM known WHERE coalesce(state_reason, '') NOT IN ('not_planned', 'wontfix')), {WIDE},
b AS (SELECT q_id, hy.ord, hy.chunk_id, updated_at, hy.score * CASE WHEN merged THEN 1.1::DOUBLE ELSE 1 END AS score FROM hy JOIN corpus c ON c.ord = hy.ord JOIN q USING (q_id) WHERE hy.score >= 0.3::DOUBLE AND list_has_any(words, {TOKENS('c.content')})),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {KEY('score')} DESC, updated_at DESC, chunk_id, ord) AS rank FROM b) SELECT q_id, rank, chunk_id, {SIX('score')} AS score FROM r WHERE rank <= 10""")
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    merged = F.when(F.col("ord") % 3 == 0, F.array(F.lit("https://forge.example/group/project/pull/7"))).otherwise(F.array(F.lit("https://forge.example/issues/7")))
    chunks = c.withColumns({"file_path": F.col("chunk_id"), "record_id": F.col("chunk_id"), "title": F.lit(""), "labels": F.array().cast("array<string>"), "links": merged, "state_reason": F.when(F.length("content") % 7 == 0, "wontfix"), "updated_at": F.lpad((F.col("ord") % 5).cast("string"), 2, "0")})
    index = indexes.held(spark, "live documents", f"{sf_dir}/documents.parquet", lambda: retrieval.live(chunks))
    return retrieval.search_knowledge(chunks, questions(spark, sf_dir), index=index).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", text.rounded(F.col("score")).alias("score"))


RECALLED = """e AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) AS ord, left(sha256(regexp_replace(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')), 16) AS id FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
corpus AS (SELECT min(ord) AS ord, id AS chunk_id, id AS file_path, 1 AS start_line, 1 AS end_line, '' AS member, min_by(text, ord) AS content FROM e GROUP BY id)"""


@query(f"""WITH {RECALLED}, {WIDE}, r AS (SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY {KEY('score')} DESC, chunk_id, ord) AS rank FROM hy JOIN q USING (q_id) WHERE score >= 0.3::DOUBLE AND list_has_any(words, {TOKENS('content')}))
SELECT q_id, rank, chunk_id, {SIX('score')} AS score FROM r WHERE rank <= 5""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = decisions(spark, sf_dir)
    index = indexes.held(spark, "decisions", f"{sf_dir}/conversations.parquet", lambda: retrieval.decision_corpus(entries))
    return retrieval.recall(entries, questions(spark, sf_dir, 5), index=index).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", text.rounded(F.col("score")).alias("score"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as remembered decisions; of one text the first counts."""
    rows = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("text"), F.struct("conv_id", "turn").alias("at"))
    own = rows.groupBy(text.decision_id(F.col("text")).alias("id")).agg(F.min_by("text", "at").alias("text"), F.min("at").alias("at"))
    return own.select("id", "text", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("area"), (F.col("at.conv_id") * 100000 + F.col("at.turn")).alias("ord"))


@query(f"""WITH {HYBRID}, w AS (SELECT q_id, rank, chunk_id, 2000 - coalesce(sum({COUNT('content')}) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM hy) SELECT * FROM w WHERE room > 0""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.within_budget(retrieval.ranked(corpus(spark, sf_dir), questions(spark, sf_dir), index=indexes.documents(spark, sf_dir)), 2000).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.col("room").cast("long").alias("room"))


# --- the event log


def _means(w: str = "true") -> str:
    return f"coalesce(avg(CASE WHEN kind = 'search' AND {w} THEN savings_ratio END), 0)"


@query(f"""WITH {LOG} SELECT count(*) FILTER (kind = 'search') AS searches, count(*) FILTER (kind = 'feedback') AS feedback, count(*) FILTER (kind = 'index') AS indexes, sum(tokens_saved) FILTER (kind = 'search')::BIGINT AS tokens_saved, {SIX(_means())} AS mean_ratio,
{SIX("coalesce(avg(top_score) FILTER (kind = 'search' AND result_count > 0), 0)")} AS mean_top_score, {SIX("coalesce(avg(latency_ms) FILTER (kind = 'search'), 0)")} AS mean_latency, {SIX("avg(CASE WHEN helpful THEN 1.0 ELSE 0.0 END) FILTER (kind = 'feedback')")} AS helpful_rate,
round(sum(tokens_saved) FILTER (kind = 'search')::DOUBLE / 1e6 * 3.0, 2) AS dollars FROM log""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(log(spark, sf_dir), PRICE).withColumn("tokens_saved", F.col("tokens_saved").cast("long"))


@query(f"""WITH {LOG} SELECT s.source, count(ord) AS searches, coalesce(sum(tokens_saved), 0)::BIGINT AS tokens_saved, {SIX('coalesce(avg(top_score) FILTER (result_count > 0), 0)')} AS mean_top_score, {SIX('coalesce(avg(savings_ratio), 0)')} AS mean_ratio, {SIX('coalesce(avg(latency_ms), 0)')} AS mean_latency
FROM (VALUES ('cli'), ('mcp')) s(source) LEFT JOIN (SELECT * FROM log WHERE kind = 'search') l USING (source) GROUP BY s.source""")
def usage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_source(log(spark, sf_dir))


NEW, OLD = f"secs >= {NOW - metrics.WEEK} AND secs < {NOW}", f"secs >= {NOW - 2 * metrics.WEEK} AND secs < {NOW - metrics.WEEK}"
TREND = lambda rows: f"WITH {LOG}, m AS ({rows}) SELECT metric, current, previous, {SIX('current - previous')} AS delta, CASE WHEN {SIX('current - previous')} > 1e-9 THEN 'up' WHEN {SIX('current - previous')} < -1e-9 THEN 'down' ELSE 'flat' END AS direction FROM m"
MEASURE = lambda name, f: f"SELECT '{name}' AS metric, {SIX(f(NEW))} AS current, {SIX(f(OLD))} AS previous FROM log"


@query(TREND(MEASURE("savings_ratio", _means)))
def savings_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.savings_trend(log(spark, sf_dir), NOW)


@query(TREND(" UNION ALL ".join([
    MEASURE("top_score", lambda w: f"coalesce(avg(top_score) FILTER (kind = 'search' AND result_count > 0 AND {w}), 0)"), MEASURE("empty_rate", lambda w: f"coalesce(avg(empty::INT) FILTER (kind = 'search' AND {w}), 0)"),
    MEASURE("low_confidence_rate", lambda w: f"coalesce(avg(low_confidence::INT) FILTER (kind = 'search' AND {w}), 0)"), MEASURE("helpful_rate", lambda w: f"coalesce(avg(helpful::INT) FILTER (kind = 'feedback' AND {w}), 0)")])))
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_trend(log(spark, sf_dir), NOW)


@query(f"""WITH {LOG} SELECT left(ts, 10) AS day, count(*) FILTER (kind = 'search') AS searches, coalesce(sum(tokens_saved) FILTER (kind = 'search'), 0)::BIGINT AS tokens_saved, {SIX(_means())} AS mean_ratio,
{SIX("coalesce(avg(top_score) FILTER (kind = 'search' AND result_count > 0), 0)")} AS mean_top_score, count(*) FILTER (kind = 'feedback' AND helpful) AS helpful, count(*) FILTER (kind = 'feedback' AND NOT helpful) AS not_helpful FROM log WHERE kind IN ('search', 'feedback') GROUP BY 1""")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.daily(log(spark, sf_dir))


@query(f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (ORDER BY secs DESC, ord DESC) AS place FROM log WHERE kind = 'search'), v AS (SELECT target_id, max_by(helpful, (secs, ord)) AS good FROM log WHERE kind = 'feedback' GROUP BY 1)
SELECT id, ts, query, CASE WHEN source = 'mcp' THEN 'mcp' ELSE 'shell' END AS source, result_count, {SIX('top_score')} AS top_score, CASE WHEN good THEN 'helpful' WHEN NOT good THEN 'not_helpful' ELSE 'none' END AS feedback, place FROM r LEFT JOIN v ON id = v.target_id WHERE place <= 20""")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent(log(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {LOG} SELECT ts, secs, files_indexed, chunks, CASE WHEN source = 'mcp' THEN 'mcp' ELSE 'shell' END AS source FROM log WHERE kind = 'index' ORDER BY secs DESC, ord DESC LIMIT 1")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.freshness(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT sum(sensitive_skipped)::BIGINT AS sensitive_skipped, count(*) AS index_runs FROM log WHERE kind = 'index'")
def secret_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.secret_safety(log(spark, sf_dir))


@query(f"WITH {LOG}, s AS (SELECT 'retrieval' AS layer, sum(tokens_saved)::BIGINT AS saved, sum(baseline_tokens)::BIGINT AS baseline FROM log WHERE kind = 'search') SELECT * FROM s UNION ALL SELECT 'total', saved, baseline FROM s")
def savings_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = ", ".join(f"{n}: struct<saved_tokens: bigint, baseline_tokens: bigint>" for n in metrics.LAYERS)
    return metrics.ledger(log(spark, sf_dir).withColumn("savings", F.lit(None).cast(f"struct<{side}>")))


@query(f"WITH {LOG} SELECT package, count(*) AS searches, sum(tokens_saved)::BIGINT AS tokens_saved, {SIX('avg(savings_ratio)')} AS mean_ratio, grouping(package)::INT AS is_total FROM log WHERE kind = 'search' GROUP BY ROLLUP (package)")
def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollup(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT kind, count(*) AS n FROM log WHERE secs >= {NOW - metrics.WEEK} OR kind = 'unknown' GROUP BY kind")
def usage_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.since(log(spark, sf_dir), NOW - metrics.WEEK).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x: F.expr(f"percentile_disc({x}) within group (order by value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


RECORD = f"""files AS (SELECT file_path, sum({COUNT('content')}) AS tokens FROM corpus GROUP BY 1), base AS (SELECT q_id, sum(tokens)::BIGINT AS baseline_tokens FROM (SELECT DISTINCT q_id, file_path FROM hy) JOIN files USING (file_path) GROUP BY 1),
own AS (SELECT q_id, count(*) AS result_count, sum({COUNT('content')})::BIGINT AS served_tokens, {SIX('max(score)')} AS top_score FROM hy GROUP BY 1)"""


@query(f"WITH {HYBRID}, {RECORD} SELECT q_id, result_count, baseline_tokens, served_tokens, greatest(baseline_tokens - served_tokens, 0) AS tokens_saved, {SIX('greatest(baseline_tokens - served_tokens, 0)::DOUBLE / baseline_tokens')} AS savings_ratio, top_score, top_score < 0.3 AS low_confidence FROM own JOIN base USING (q_id)")
def search_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    files = c.groupBy("file_path").agg(F.sum(text.token_count(F.col("content"))).alias("tokens"))
    return metrics.search_record(retrieval.ranked(c, questions(spark, sf_dir), index=indexes.documents(spark, sf_dir)), files).select("q_id", "result_count", "baseline_tokens", "served_tokens", "tokens_saved", "savings_ratio", "top_score", "low_confidence")


# --- quality


@query(f"""WITH q AS (SELECT vec_id AS q_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q_id, q.label, vec_id, e.label AS got, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {KEY('s')} DESC, lpad(vec_id::VARCHAR, 12, '0')) AS rank FROM s), m AS (SELECT q_id, count(*) FILTER (got = label) AS hits, min(rank) FILTER (got = label) AS first FROM r WHERE rank <= 10 GROUP BY q_id)
SELECT q_id, hits AS relevant, (CASE WHEN hits > 0 THEN 1 ELSE 0 END)::BIGINT AS found, {SIX('hits / 10.0')} AS precision, {SIX('coalesce(1.0 / first, 0)')} AS mrr FROM m""")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = relevance(spark, sf_dir)
    return scored.select("q_id", "relevant", "found", text.rounded(F.col("precision")).alias("precision"), text.rounded(F.col("mrr")).alias("mrr"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors against the label of the query: the label is the one anchor."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    got = embeddings_topk(spark, sf_dir).join(e, "vec_id").select("q_id", "rank", F.lit("").alias("file_path"), F.col("label").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    cases = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.lit(10).alias("k"), "label")
    wanted = cases.select("q_id", quality.anchors(F.concat(F.lit("#"), "label")).alias("anchor"))
    return quality.scores(got, wanted, cases)


@query(ORACLES["relevance_scores"].replace("SELECT q_id, hits AS relevant", ", p AS (SELECT q_id, hits, hits / 10.0::DOUBLE AS p, (CASE WHEN hits > 0 THEN 1 ELSE 0 END)::DOUBLE AS r, coalesce(1.0::DOUBLE / first, 0) AS rr FROM m) SELECT count(*) AS cases, "
       f"{SIX('avg(p)')} AS precision, {SIX('avg(r)')} AS recall, {SIX('avg(rr)')} AS mrr, {SIX('avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)')} AS f1, count(*) FILTER (r = 1) AS proven FROM p -- ", 1).replace("GROUP BY q_id)\n, p", "GROUP BY q_id), p"))
def relevance_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.macro(relevance(spark, sf_dir))


@query("""WITH d AS (SELECT o_orderpriority AS grp, o_totalprice - avg(o_totalprice) OVER () AS delta FROM orders) SELECT grp, count(*) AS n, round(avg(delta), 4) AS mean FROM d GROUP BY grp""")
def paired_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    base = o.agg(F.avg("o_totalprice")).first()[0]
    own = quality.paired(o.select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") - base).alias("delta")), "grp")
    return own.select("grp", "n", F.round("mean", 4).alias("mean"))


@query()
def paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    base = o.agg(F.avg("o_totalprice")).first()[0]
    return quality.paired(o.select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") - base).alias("delta")), "grp")


RUNS = """r AS (SELECT o_custkey AS question_id, CASE WHEN o_orderkey % 2 = 0 THEN 'on' ELSE 'off' END AS condition, max_by((o_orderstatus, o_totalprice), o_orderkey) AS last FROM orders GROUP BY 1, 2),
g AS (SELECT question_id, condition, CASE last[1] WHEN 'P' THEN 'punt' WHEN 'F' THEN 'correct' ELSE 'incorrect' END AS grade, last[2] / 1000.0::DOUBLE AS cost FROM r JOIN customer ON c_custkey = question_id)"""


def ab_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    answer = F.when(F.col("o_orderstatus") == "P", "I am not sure about this one").when(F.col("o_orderstatus") == "F", "The status is FINAL").otherwise("The status is open")
    runs = o.select(F.col("o_custkey").alias("question_id"), F.when(F.col("o_orderkey") % 2 == 0, "on").otherwise("off").alias("condition"), F.col("o_orderkey").alias("ord"), answer.alias("answer"), F.lit(None).cast("boolean").alias("punted"), (F.col("o_totalprice") / 1000.0).alias("cost_usd"), F.lit(0.0).alias("subagent_cost_usd"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("final")).alias("must_include"))
    return quality.graded(asked, runs)


@query(f"WITH {RUNS} SELECT condition, count(*) AS runs, count(*) FILTER (grade = 'correct') AS correct, count(*) FILTER (grade = 'incorrect') AS incorrect, count(*) FILTER (grade = 'punt') AS punts, round(coalesce(sum(cost) FILTER (grade = 'correct'), 0), 2) AS correct_cost FROM g GROUP BY condition")
def ab_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.arms(ab_runs(spark, sf_dir))


@query(f"WITH {RUNS}, p AS (SELECT a.cost AS off_, b.cost AS on_ FROM g a JOIN g b USING (question_id) WHERE a.condition = 'off' AND b.condition = 'on' AND a.grade = 'correct' AND b.grade = 'correct') SELECT count(*) AS paired, round(sum(off_), 2) AS off_cost, round(sum(on_), 2) AS on_cost, {SIX('(sum(off_) - sum(on_)) / sum(off_)')} AS saved FROM p")
def ab_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.paired_cost(ab_runs(spark, sf_dir))


# --- integrity and sessions


def part_digests(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """part as two snapshots: brands ending in 1 are only in the old one, in 2 only in the new one, and the sizes 10 to 12 differ."""
    p = table(spark, sf_dir, "part").where(~F.col("p_brand").endswith(str(3 - version)))
    edited = F.when(F.lit(version == 2) & F.col("p_size").between(10, 12), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return quality.record_digests(p.select(F.col("p_partkey").alias("record_id"), F.lit(1).alias("start_line"), F.lit("a").alias("chunk_id"), edited.alias("content")))


@query("""SELECT p_partkey AS record_id, CASE WHEN p_brand LIKE '%2' THEN 'added' WHEN p_brand LIKE '%1' THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2' OR p_size BETWEEN 10 AND 12""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.snapshot_diff(part_digests(spark, sf_dir, 1), part_digests(spark, sf_dir, 2))


@query("SELECT conv_id AS record_id, sha256(string_agg(strlen(coalesce(text, '')) || ':' || coalesce(text, ''), '' ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.record_digests(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("start_line"), F.col("role").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content")))


@query(f"WITH {CORPUS} SELECT language, CASE WHEN grouping(kind) = 0 THEN 'module' END AS kind, count(*) AS chunks, count(DISTINCT file_path) AS files, {SIX('avg(' + COUNT('content') + ')')} AS mean_tokens FROM (SELECT *, 'module' AS kind FROM corpus) GROUP BY GROUPING SETS ((language), (kind), ())")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.store_stats(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT count(*) AS chunks, 0::BIGINT AS repeated_ids, count(*) FILTER (content = '') AS empty, 0::BIGINT AS bad_spans, 0::BIGINT AS bad_ids, 0::BIGINT AS bad_vectors FROM corpus")
def doctor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.embedded(corpus(spark, sf_dir))
    own = text.chunk_id(F.concat("file_path", F.lit("#"), F.col("ord").cast("string")), F.col("start_line"), F.col("end_line"), F.col("content"))
    return quality.doctor(c.withColumn("chunk_id", own).withColumn("file_path", F.concat("file_path", F.lit("#"), F.col("ord").cast("string"))))


@query("""WITH e AS (SELECT conv_id AS session, turn AS ord, role, text FROM conversations), f AS (SELECT session, role, row_number() OVER (PARTITION BY session ORDER BY role) AS i FROM (SELECT DISTINCT session, role FROM e)),
t AS (SELECT session, text, row_number() OVER (PARTITION BY session ORDER BY pos, text) AS i FROM (SELECT session, text, min(ord) AS pos FROM e WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL))
SELECT session, (SELECT count(*) FROM f WHERE f.session = s.session) AS n_files, (SELECT string_agg(role, ',' ORDER BY i) FROM f WHERE f.session = s.session AND i <= 20) AS files, (SELECT count(*) FROM t WHERE t.session = s.session) AS n_queries, (SELECT sha256(string_agg(text, chr(10) ORDER BY i)) FROM t WHERE t.session = s.session AND i <= 20) AS queries FROM (SELECT DISTINCT session FROM e) s""")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    events = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.when(user, "search").otherwise("expand").alias("kind"), F.when(user, F.col("text")).alias("query"), F.col("role").alias("file_path"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("id"))
    out = metrics.session_digest(events)
    return out.select("session", "n_files", F.array_join("files", ",").alias("files"), F.coalesce("n_queries", F.lit(0)).alias("n_queries"), F.sha2(F.array_join("queries", "\n"), 256).alias("queries"))
