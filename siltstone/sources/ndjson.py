"""Line formats: the tolerant event log, strict feeds and suites, decision files, A/B runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import text
from siltstone.session import written

KNOWN = ("search", "index", "feedback")
COUNTERS = ("top_k", "result_count", "baseline_tokens", "served_tokens", "tokens_saved", "files_indexed", "chunks", "index_bytes", "sensitive_skipped")
NUMBERS = ("savings_ratio", "top_score", "mean_score", "latency_ms", "duration_ms")
FLAGS = ("graph_enabled", "empty", "low_confidence", "helpful", "full")
STRINGS = ("schema", "id", "query", "embedder", "sha", "target_id", "note")
LAYERS = ("retrieval", "chunk_compression", "grammar", "output", "memory", "turn_summarization", "progressive_disclosure")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1): lines of text files with where they stand. Many tasks read a file, each a range of its bytes; a line's number is its
    place in its range and the lines of the ranges before it (a row a range)."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    held = written(raw.withColumn("at", F.monotonically_increasing_id()))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = held.join(starts.select("file", "block", "first", "base"), ["file", "block"])
    return rows.select("file", (F.col("base") + F.col("at") - F.col("first") + 1).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def placed(spark: SparkSession, path: str) -> DataFrame:
    """ord, value: lines of text files, which many tasks may read, with a place that orders them: file, where the block begins, row in it."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))
    return rows.select("ord", F.regexp_replace("value", r"\r\z", "").alias("value"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def counter(v: Column, name: str) -> Column:
    """A whole number as it is written; anything else is 0."""
    return F.when(_kind(v, f"$.{name}") == "BIGINT", F.greatest(F.try_variant_get(v, f"$.{name}", "bigint"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def number(v: Column, name: str) -> Column:
    return F.when(_kind(v, f"$.{name}").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, f"$.{name}", "double")).otherwise(F.lit(0.0))


def flag(v: Column, name: str) -> Column:
    return F.when(_kind(v, f"$.{name}") == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")).otherwise(F.lit(False))


def string(v: Column, name: str) -> Column:
    return F.when(_kind(v, f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def events(lines: DataFrame) -> DataFrame:
    """Typed events of lines (ord, value). kind is null for a line that is blank, no object, or without a valid time: it is
    skipped and counted, never an error. A line whose event is unknown is kept as such."""
    v, event, ts, secs = (F.col(c) for c in ("v", "event", "ts", "secs"))
    # each step is a row's own array of one, so that what reads it, filters too, doesn't work it out again
    once = lambda rows, name, value: rows.select("*", F.explode(F.array(value)).alias(name))
    rows = once(lines.select("ord", "value"), "raw", F.try_parse_json("value"))
    rows = once(rows, "v", F.when(F.schema_of_variant("raw").startswith("OBJECT"), F.col("raw")))
    rows = once(once(rows, "event", string(v, "event")), "ts", string(v, "ts"))
    rows = once(rows, "secs", text.iso_seconds(ts))
    kind = F.when(secs.isNull(), F.lit(None).cast("string")).when(event.isin(*KNOWN), event).otherwise("unknown")
    source = F.coalesce(string(v, "source"), F.when(event == "index", "local").otherwise("cli"))
    layers = [F.struct(counter(v, f"savings.{n}.saved_tokens").alias("saved_tokens"), counter(v, f"savings.{n}.baseline_tokens").alias("baseline_tokens")).alias(n) for n in LAYERS]
    savings = F.when(_kind(v, "$.savings").startswith("OBJECT"), F.struct(*layers))
    return rows.select("ord", kind.alias("kind"), ts.alias("ts"), secs.alias("secs"), source.alias("source"), savings.alias("savings"), *[F.coalesce(string(v, c), F.lit("")).alias(c) for c in STRINGS],
                       *[counter(v, c).alias(c) for c in COUNTERS], *[number(v, c).alias(c) for c in NUMBERS], *[flag(v, c).alias(c) for c in FLAGS])


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of a log, and one row with how many lines were skipped."""
    parsed = events(placed(spark, path))
    return parsed.where("kind is not null"), parsed.agg(F.count_if(F.col("kind").isNull()).alias("skipped"))


def strict(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A feed of which one bad line is an error that names it."""
    fields = StructType.fromDDL(schema)
    rows = numbered(spark, path).where("trim(value) <> ''").select("line", "value", F.from_json("value", fields, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    bad = F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT") | F.coalesce(*[F.when(F.col(f"r.{c}").isNull(), F.lit(True)) for c in required], F.lit(False))
    ok = F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": not a valid record")))).otherwise(F.col("r"))
    return rows.select("line", ok.alias("r")).select("line", "r.*")


def verify_manifest(spark: SparkSession, feed: str, records: int, sha256: str) -> None:
    """The feed's digest and number of records must be what its manifest says."""
    own = spark.read.format("binaryFile").load(feed).select(F.sha2("content", 256).alias("sha")).first()["sha"]
    n = numbered(spark, feed).where("trim(value) <> ''").count()
    if own != sha256 or n != records:
        raise ValueError(f"feed does not match its manifest: {n} records with digest {own}, expected {records} with {sha256}")


def read_decisions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, text, tags, area, ts, ord of decision files in order; malformed lines are left out, the first of an id counts."""
    rows = None
    for at, path in enumerate(paths):
        part = numbered(spark, path).withColumn("file_ord", F.lit(at))
        rows = part if rows is None else rows.unionByName(part)
    schema = "id string, text string, tags array<string>, area string, ts string"
    own = rows.select(F.struct("file_ord", "line").alias("at"), F.from_json("value", schema).alias("r")).where("r.id is not null and r.text is not null")
    return own.groupBy("r.id").agg(F.min_by("r", "at").alias("r"), F.min("at").alias("at")).select("r.*", (F.col("at.file_ord") * (1 << 40) + F.col("at.line")).alias("ord")).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Tolerant rows, and how many lines were bad."""
    rows = numbered(spark, path).where("trim(value) <> ''").select("line", F.try_parse_json("value").alias("v"), F.from_json("value", schema).alias("r"))
    good = F.schema_of_variant("v").startswith("OBJECT")
    return rows.where(good).select(F.col("line").alias("ord"), "r.*"), rows.where(~F.coalesce(good, F.lit(False))).count()


def suite(body: str, wanted: str = "expected") -> tuple[dict, list[dict]]:
    """Header and cases of a small suite in text: an object with schema first (if any), then a case a line. wanted: the field with what is
    expected. Fails with the line's number."""
    header, cases = {}, []
    for n, line in enumerate(body.splitlines(), 1):
        if not line.strip():
            continue
        try:
            one = json.loads(line)
            if "schema" in one and "query" not in one and not cases:
                header = one
                continue
            if not str(one.get("query", "")).strip() or not one.get(wanted) or one.get("k", 1) < 1 or not all(isinstance(x, str) and x for x in one[wanted]):
                raise ValueError(f"query, {wanted} and k must be usable")
            cases.append({"id": one.get("id") or f"q{n}", "query": one["query"], wanted: one[wanted], "k": one.get("k")})
        except (ValueError, TypeError, AttributeError) as e:
            raise ValueError(f"line {n}: {e}") from e
    return header, cases
