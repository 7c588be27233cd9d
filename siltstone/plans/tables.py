"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text

NOW = 1706745600  # 2024-02-01T00:00:00Z
PRICE = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: a source's folder holds a file for each language."""
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("ord"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("file_path"),
                    F.lit(1).cast("long").alias("start_line"), text.line_count(content).alias("end_line"), F.lit("module").alias("chunk_type"), F.lit("module").alias("kind"), F.col("lang").alias("language"), F.col("source").alias("member"), content.alias("content"))


def questions(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.coalesce("text", F.lit("")).alias("query"), F.lit(k).cast("long").alias("k"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: purchases, views and clicks are searches, signups feedback on an earlier event, errors index runs."""
    e = table(spark, sf_dir, "events")
    n = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    kind = F.when(F.col("event_type").isin("purchase", "view", "click"), "search").when(F.col("event_type") == "signup", "feedback").when(F.col("event_type") == "error", "index").otherwise("unknown")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("ord"), kind.alias("kind"), text.iso_text(secs).alias("ts"), secs.alias("secs"), F.col("event_id").cast("string").alias("id"), F.when(F.col("user_id") % 3 == 0, "mcp").otherwise("shell").alias("source"),
                    F.concat(F.lit("query "), n.cast("string")).alias("query"), (n % 5).alias("result_count"), (n + 100).alias("baseline_tokens"), F.lit(100).cast("long").alias("served_tokens"), n.alias("tokens_saved"), (n / (n + 100)).alias("savings_ratio"),
                    ((n % 97) / 100.0).alias("top_score"), (n % 5 == 0).alias("empty"), (n % 97 < 30).alias("low_confidence"), F.col("value").alias("latency_ms"), (F.col("event_id") - 1 - n % 7).cast("string").alias("target_id"), (n % 2 == 0).alias("helpful"),
                    (n + 1).alias("files_indexed"), (n * 3).alias("chunks"), (n % 4).alias("sensitive_skipped"), F.concat(F.lit("package"), (F.col("user_id") % 11).cast("string")).alias("package"))
