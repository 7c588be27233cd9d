"""The streaming twins: daily series and session counters over a log that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import metrics
from siltstone.session import removed
from siltstone.sources import ndjson


def lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Events of the text files that appear in a folder; their place in the log is not known, so ord is null."""
    raw = spark.readStream.options(**options).text(folder)
    return ndjson.events(raw.select(F.lit(None).cast("long").alias("ord"), "value")).where("kind is not null")


def daily(events: DataFrame, delay: str = "3650 days") -> DataFrame:
    """The daily series with a watermark: a day is final when events that much later have come; what comes for it after that is
    not counted."""
    s, f = metrics.is_kind("search"), metrics.is_kind("feedback")
    rows = events.where(s | f).withColumn("at", F.timestamp_seconds("secs")).withWatermark("at", delay)
    return rows.groupBy(F.window("at", "1 day").alias("w")).agg(
        F.count_if(s).alias("searches"), F.coalesce(F.sum(F.when(s, F.col("tokens_saved"))), F.lit(0)).alias("tokens_saved"), F.count_if(f & F.col("helpful")).alias("helpful"), F.count_if(f & ~F.col("helpful")).alias("not_helpful"),
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "searches", "tokens_saved", "helpful", "not_helpful")


def sessions(events: DataFrame, key: str = "source") -> DataFrame:
    """Searches and tokens of each session so far."""
    return events.where(metrics.is_kind("search")).groupBy(key).agg(F.count(F.lit(1)).alias("searches"), F.sum("tokens_saved").alias("tokens_saved"), F.sum("served_tokens").alias("served_tokens"))


def trends_each_trigger(events: DataFrame, now, sink, checkpoint: str, step: int = 3600) -> StreamingQuery:
    """Writes each micro-batch to its own folder of sink, so that one that is tried again replaces itself, and the trends of the trailing windows,
    which end at now() (rounded down to a step). They come from partials: sums and counts by metric and step, those of the batch before merged
    with this one's and written under this one's number. A trigger reads no event again, and partials of two windows alone."""
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("day", F.to_date(F.timestamp_seconds("secs"))).write.mode("overwrite").partitionBy("day").parquet(f"{sink}/events/batch={epoch}")
        parts, before = metrics.partials(batch, step), [n for n in epochs(spark, f"{sink}/partials") if n < epoch]
        if before:
            parts = metrics.merged(parts.unionByName(spark.read.parquet(f"{sink}/partials/epoch={max(before)}")))
        path = f"{sink}/partials/epoch={epoch}"
        parts.where(F.col("at") >= now() - 2 * metrics.WEEK - step).coalesce(1).write.mode("overwrite").parquet(path)
        metrics.trends_of(spark.read.parquet(path), now(), step).write.mode("overwrite").parquet(f"{sink}/trends")
        for n in before:
            if n < max(before):
                removed(spark, f"{sink}/partials/epoch={n}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def epochs(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("epoch=")) if fs.exists(p) else []
