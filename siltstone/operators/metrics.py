"""Analytics over the event log: totals, sources, trends, daily series, recent searches, savings.

A log is one frame of typed events: ord (place in the log), kind (search, feedback, index or unknown), ts (as written), secs, id,
source, query, result_count, baseline_tokens, served_tokens, tokens_saved, savings_ratio, top_score, empty, low_confidence,
latency_ms, target_id, helpful, files_indexed, chunks, sensitive_skipped, sha. now and price are arguments: no report reads a clock.
Each report is one aggregation over the log, partial in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text

WEEK = 7 * 86400
U64 = 18446744073709551615
LAYERS = ("retrieval", "chunk_compression", "grammar", "output", "memory", "turn_summarization", "progressive_disclosure")


def saturating(value: Column) -> Column:
    """A sum that stops at the largest unsigned 64-bit number."""
    return F.least(F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(str(U64)).cast("decimal(20,0)"))


def mean(value: Column, when: Column) -> Column:
    """Over the rows for which it holds; 0 without any."""
    return F.coalesce(F.avg(F.when(when, value)), F.lit(0.0))


def share(yes: Column, all_: Column) -> Column:
    return F.when(F.count_if(all_) > 0, F.count_if(yes & all_) / F.count_if(all_))


def dollars(tokens: Column, price: float) -> Column:
    return F.round(tokens.cast("double") / 1e6 * price, 2)


def is_kind(kind: str) -> Column:
    return F.col("kind") == kind


def origin() -> Column:
    return F.when(F.col("source") == "mcp", "mcp").otherwise("cli")


def since(log: DataFrame, cutoff: int) -> DataFrame:
    """Events from the cutoff on; unknown ones always stay."""
    return log.where((F.col("secs") >= cutoff) | is_kind("unknown"))


def totals(log: DataFrame, price: float) -> DataFrame:
    s, f = is_kind("search"), is_kind("feedback")
    saved = saturating(F.when(s, F.col("tokens_saved")))
    return log.agg(F.count_if(s).alias("searches"), F.count_if(f).alias("feedback"), F.count_if(is_kind("index")).alias("indexes"), saved.alias("tokens_saved"),
                   text.rounded(mean(F.col("savings_ratio"), s)).alias("mean_ratio"), text.rounded(mean(F.col("top_score"), s & (F.col("result_count") > 0))).alias("mean_top_score"),
                   text.rounded(mean(F.col("latency_ms"), s)).alias("mean_latency"), text.rounded(share(F.col("helpful"), f)).alias("helpful_rate"), dollars(saved, price).alias("dollars"))


def by_source(log: DataFrame) -> DataFrame:
    """cli and mcp, both always there."""
    own = log.where(is_kind("search")).groupBy(origin().alias("source")).agg(
        F.count(F.lit(1)).alias("searches"), F.sum("tokens_saved").alias("tokens_saved"), F.avg(F.when(F.col("result_count") > 0, F.col("top_score"))).alias("top"), F.avg("savings_ratio").alias("ratio"), F.avg("latency_ms").alias("latency"))
    both = log.sparkSession.createDataFrame([("cli",), ("mcp",)], "source string")
    zero = lambda c: text.rounded(F.coalesce(F.col(c), F.lit(0.0)))
    return both.join(own, "source", "left").select("source", F.coalesce("searches", F.lit(0)).alias("searches"), F.coalesce("tokens_saved", F.lit(0)).cast("long").alias("tokens_saved"), zero("top").alias("mean_top_score"), zero("ratio").alias("mean_ratio"), zero("latency").alias("mean_latency"))


def windows(now: int) -> tuple[Column, Column]:
    """The seven days up to now, and the seven before; half open."""
    secs = F.col("secs")
    return (secs >= now - WEEK) & (secs < now), (secs >= now - 2 * WEEK) & (secs < now - WEEK)


def _trend(log: DataFrame, now: int, measures: dict[str, tuple]) -> DataFrame:
    """metric, current, previous, delta (of the rounded ones), direction."""
    new, old = windows(now)
    cells = [c for name, f in measures.items() for c in (text.rounded(f(new)).alias(f"{name}_current"), text.rounded(f(old)).alias(f"{name}_previous"))]
    wide = log.agg(*cells)
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_current").alias("current"), F.col(f"{n}_previous").alias("previous")) for n in measures])))
    delta = text.rounded(F.col("current") - F.col("previous"))
    return long.withColumn("delta", delta).withColumn("direction", text.direction(F.col("delta")))


def savings_trend(log: DataFrame, now: int) -> DataFrame:
    s = is_kind("search")
    return _trend(log, now, {"savings_ratio": lambda w: mean(F.col("savings_ratio"), s & w)})


def quality_trend(log: DataFrame, now: int) -> DataFrame:
    s, f = is_kind("search"), is_kind("feedback")
    rate = lambda c, k: lambda w: F.coalesce(share(F.col(c), k & w), F.lit(0.0))
    return _trend(log, now, {"top_score": lambda w: mean(F.col("top_score"), s & w & (F.col("result_count") > 0)), "empty_rate": rate("empty", s), "low_confidence_rate": rate("low_confidence", s), "helpful_rate": rate("helpful", f)})


def measures() -> dict[str, tuple[Column, Column]]:
    """What the trends are means of: value and rows that count, by metric."""
    s, f = is_kind("search"), is_kind("feedback")
    return {"savings_ratio": (F.col("savings_ratio"), s), "top_score": (F.col("top_score"), s & (F.col("result_count") > 0)), "empty_rate": (F.col("empty").cast("double"), s),
            "low_confidence_rate": (F.col("low_confidence").cast("double"), s), "helpful_rate": (F.col("helpful").cast("double"), f)}


def partials(log: DataFrame, step: int = 3600) -> DataFrame:
    """at (where a stretch of `step` seconds begins), metric, total, n: sums and counts, which add up over any split of the log."""
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.when(when, value).alias("value")) for name, (value, when) in measures().items()])
    rows = log.where("secs is not null").select((F.floor(F.col("secs") / step) * step).alias("at"), F.inline(each)).where("value is not null")
    return rows.groupBy("at", "metric").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("at", "metric").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trends_of(parts: DataFrame, now: int, step: int = 3600) -> DataFrame:
    """All trends from partials; the windows end at now, rounded down to a whole step."""
    end = now // step * step
    inside = lambda lo, hi: (F.col("at") >= lo) & (F.col("at") < hi)
    sums = parts.groupBy("metric").agg(*[f(F.when(inside(lo, hi), F.col(c))).alias(f"{side}_{c}") for side, lo, hi in (("current", end - WEEK, end), ("previous", end - 2 * WEEK, end - WEEK)) for c, f in (("total", F.sum), ("n", F.sum))])
    names = parts.sparkSession.createDataFrame([(m,) for m in measures()], "metric string")
    mean_ = lambda side: text.rounded(F.when(F.col(f"{side}_n") > 0, F.col(f"{side}_total") / F.col(f"{side}_n")).otherwise(0.0)).alias(side)
    long = names.join(sums, "metric", "left").select("metric", mean_("current"), mean_("previous"))
    delta = text.rounded(F.col("current") - F.col("previous"))
    return long.withColumn("delta", delta).withColumn("direction", text.direction(F.col("delta")))


def daily(log: DataFrame) -> DataFrame:
    """A row a UTC day with a search or feedback."""
    s, f = is_kind("search"), is_kind("feedback")
    return log.where(s | f).groupBy(text.utc_day(F.col("secs")).alias("day")).agg(
        F.count_if(s).alias("searches"), F.coalesce(F.sum(F.when(s, F.col("tokens_saved"))), F.lit(0)).alias("tokens_saved"), text.rounded(mean(F.col("savings_ratio"), s)).alias("mean_ratio"),
        text.rounded(mean(F.col("top_score"), s & (F.col("result_count") > 0))).alias("mean_top_score"), F.count_if(f & F.col("helpful")).alias("helpful"), F.count_if(f & ~F.col("helpful")).alias("not_helpful"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest searches with the latest verdict on each."""
    newest = log.where(is_kind("search")).orderBy(F.col("secs").desc(), F.col("ord").desc()).limit(n).select("id", "ts", "secs", "ord", "query", "source", "result_count", "top_score")
    verdicts = log.where(is_kind("feedback")).groupBy("target_id").agg(F.max_by("helpful", F.struct("secs", "ord")).alias("helpful"))
    verdict = F.when(F.col("helpful"), "helpful").when(~F.col("helpful"), "not_helpful").otherwise("none")
    return newest.join(verdicts, newest["id"] == verdicts["target_id"], "left").select("id", "ts", "query", "source", "result_count", text.rounded(F.col("top_score")).alias("top_score"), verdict.alias("feedback"), F.row_number().over(Window.orderBy(F.col("secs").desc(), F.col("ord").desc())).alias("place"))


def freshness(log: DataFrame) -> DataFrame:
    """The latest index event."""
    last = F.max_by(F.struct("ts", "secs", "files_indexed", "chunks", "source"), F.struct("secs", "ord"))
    return log.where(is_kind("index")).agg(last.alias("last")).where("last is not null").select("last.*")


def secret_safety(log: DataFrame) -> DataFrame:
    return log.where(is_kind("index")).agg(F.coalesce(F.sum("sensitive_skipped"), F.lit(0)).alias("sensitive_skipped"), F.count(F.lit(1)).alias("index_runs"))


def ledger(log: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """layer, saved, baseline and a total; savings: struct of layers. An event without it counts for retrieval."""
    own = [F.struct(F.lit(n).alias("layer"), F.col(f"savings.{n}.saved_tokens").alias("saved"), F.col(f"savings.{n}.baseline_tokens").alias("baseline")) for n in layers]
    legacy = F.array(F.struct(F.lit("retrieval").alias("layer"), F.col("tokens_saved").alias("saved"), F.col("baseline_tokens").alias("baseline")))
    rows = log.where(is_kind("search")).select(F.inline(F.when(F.col("savings").isNotNull(), F.array(*own)).otherwise(legacy)))
    sums = rows.groupBy("layer").agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline"))
    return sums.unionByName(sums.agg(F.lit("total").alias("layer"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline")))


def rollup(log: DataFrame, package: str = "package") -> DataFrame:
    """All members together (package null) and each package by itself."""
    return log.where(is_kind("search")).rollup(package).agg(F.count(F.lit(1)).alias("searches"), F.sum("tokens_saved").alias("tokens_saved"), text.rounded(F.avg("savings_ratio")).alias("mean_ratio"), F.grouping(package).cast("int").alias("is_total"))


def search_record(results: DataFrame, file_tokens: DataFrame) -> DataFrame:
    """For each query: what whole files would have cost, what was served, what that saved."""
    base = results.select("q_id", "file_path").distinct().join(file_tokens, "file_path").groupBy("q_id").agg(F.sum("tokens").alias("baseline_tokens"))
    own = results.groupBy("q_id").agg(F.count(F.lit(1)).alias("result_count"), F.sum(text.token_count(F.col("content"))).alias("served_tokens"), text.rounded(F.max("score")).alias("top_score"), text.rounded(F.avg("score")).alias("mean_score"))
    saved = F.greatest(F.col("baseline_tokens") - F.col("served_tokens"), F.lit(0))
    return own.join(base, "q_id", "left").withColumn("baseline_tokens", F.coalesce("baseline_tokens", F.lit(0))).withColumn("tokens_saved", saved).withColumn(
        "savings_ratio", text.rounded(F.when(F.col("baseline_tokens") > 0, F.col("tokens_saved") / F.col("baseline_tokens")).otherwise(0.0))).withColumn("low_confidence", F.col("top_score") < 0.30)


def grammar_savings(rows: DataFrame) -> DataFrame:
    """For each query: tokens of the verbose form, and what the compact one saves. rows: rank, score, package, file_path, start_line, end_line, chunk_type, kind, chunk_id."""
    cols = [F.col(c) for c in ("rank", "score", "package", "file_path", "start_line", "end_line", "chunk_type", "kind", "chunk_id")]
    sizes = rows.groupBy("q_id").agg(F.sum(F.octet_length(text.compact_line(*cols)) + 1).alias("compact"), (F.sum(F.octet_length(text.verbose_block(*cols))) + F.count(F.lit(1)) - 1).alias("verbose"))
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / 4)).cast("long")
    return sizes.select("q_id", tokens("verbose").alias("baseline_tokens"), F.greatest(tokens("verbose") - tokens("compact"), F.lit(0)).alias("saved_tokens"))


def session_digest(events: DataFrame, most: int = 20) -> DataFrame:
    """For each session: distinct files and chunks (sorted), queries in order of first sight, decisions; the first `most` of
    each and how many more there are. events: session, ord, kind, query, file_path, chunk_id, id, label."""
    def listed(name: str, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
        each = rows.where(F.col(key).isNotNull()).groupBy("session", key).agg(F.min("ord").alias("at"))
        place = F.row_number().over(Window.partitionBy("session").orderBy("at" if order else key, key))
        each = each.withColumn("place", place)
        return each.groupBy("session").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", key)))), lambda x: x[key]).alias(name))
    out = events.select("session").distinct()
    for part in (listed("files", events, "file_path"), listed("chunks", events, "chunk_id"), listed("queries", events.where(is_kind("search")), "query", "seen"), listed("decisions", events.where(is_kind("decision")), "id", "seen")):
        out = out.join(part, "session", "left")
    return out
