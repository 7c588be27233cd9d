"""Reports over result sets, suites, stores and logs: what is printed, gated or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import metrics, quality

# --- suites


def suite_scores(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case (q_id, k, expect: array of records): precision at k, recall, reciprocal rank, F1, and whether all it expects
    was found. hits: q_id, rank, record_id."""
    wanted = cases.select("q_id", F.explode("expect").alias("anchor"))
    met = hits.join(wanted, (hits["q_id"] == wanted["q_id"]) & (hits["record_id"] == wanted["anchor"])).select(hits["q_id"], "rank", "anchor")
    rows = quality.scores(hits, wanted, cases, matched=met)
    return rows.withColumn("proven", F.col("found") == F.col("anchors"))


def suite_gate(scored: DataFrame, floor: float | None = None) -> DataFrame:
    """One row: means, how many cases are proven, and whether the suite passes: all proven or, with a floor, that share of them."""
    mean = lambda c: text.rounded(F.coalesce(F.avg(c), F.lit(0.0))).alias(c)
    n, proven = F.count(F.lit(1)), F.count_if("proven")
    enough = proven == n if floor is None else proven >= F.lit(floor) * n
    return scored.agg(n.alias("queries"), proven.alias("proven"), mean("precision"), mean("recall"), mean("mrr"), mean("f1"), ((n > 0) & enough).alias("passes"))


def bench_summary(results: DataFrame, cases: DataFrame, file_tokens: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row: share of cases with an expected path among the best 5 and 10, mean share of tokens saved against whole files, and the
    nearest-rank percentiles of latency. results: q_id, rank, file_path, tokens; cases: q_id, expected (parts of paths); latencies: ms."""
    hit = F.exists("expected", lambda x: (x != "") & F.contains(F.col("file_path"), x))
    first = results.join(cases, "q_id").where(hit).groupBy("q_id").agg(F.min("rank").alias("first"))
    served = results.groupBy("q_id").agg(F.sum("tokens").alias("served"))
    base = results.select("q_id", "file_path").distinct().join(file_tokens.select("file_path", F.col("tokens").alias("whole")), "file_path").groupBy("q_id").agg(F.sum("whole").alias("baseline"))
    rows = cases.select("q_id").join(first, "q_id", "left").join(served, "q_id", "left").join(base, "q_id", "left")
    saved = F.when(F.col("baseline") > 0, 1 - F.coalesce("served", F.lit(0)) / F.col("baseline"))
    share = lambda k: text.rounded(F.coalesce(F.avg((F.coalesce("first", F.lit(k + 1)) <= k).cast("int")), F.lit(0.0)))
    quality_ = rows.agg(share(5).alias("recall_5"), share(10).alias("recall_10"), text.rounded(F.coalesce(F.avg(saved), F.lit(0.0)) * 100).alias("saved_percent"))
    speed = latencies.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"))
    return quality_.crossJoin(speed)  # a row each


# --- result sets


def budgeted(results: DataFrame, limit: int) -> DataFrame:
    """Rows of each query until its tokens are spent; what the last one has beyond them is cut off."""
    before = F.coalesce(F.sum(text.token_count(F.col("content"))).over(Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = results.withColumn("room", F.lit(limit) - before).where("room > 0")
    return rows.withColumn("cut", text.token_count(F.col("content")) > F.col("room")).withColumn("content", text.trimmed(F.col("content"), F.col("room")))


def with_package(results: DataFrame, members: DataFrame) -> DataFrame:
    """Results with the package of their member (members: member, package), the member's own name where it has none."""
    return results.join(members.select("member", "package"), "member", "left").withColumn("package", F.coalesce("package", "member"))


def file_mates(corpus: DataFrame, chunk: str) -> DataFrame:
    """The other chunks of the file of a chunk, in order of place."""
    own = corpus.where(F.col("chunk_id") == chunk).select("file_path").distinct()
    return corpus.join(own, "file_path", "left_semi").where(F.col("chunk_id") != chunk).orderBy("start_line", "chunk_id")


def sections(corpus: DataFrame) -> DataFrame:
    """Each chunk with the ones before and after it in its file (or record)."""
    order = Window.partitionBy("file_path").orderBy("start_line", "chunk_id")
    return corpus.withColumn("before", F.lag("chunk_id").over(order)).withColumn("after", F.lead("chunk_id").over(order)).withColumn("nth", F.row_number().over(order).cast("long"))


def conformance(corpus: DataFrame) -> DataFrame:
    """A line of JSON for each chunk, with its tokens, sorted by (file_path, start_line, chunk_id) in ranges."""
    own = corpus.select("file_path", "start_line", "end_line", "chunk_type", "kind", "chunk_id", text.token_count(F.col("content")).alias("token_count"))
    key = ("file_path", "start_line", "chunk_id")
    return own.orderBy(*key).select(*key, F.to_json(F.struct(*sorted(own.columns))).alias("value"))


# --- logs and stores


def log_union(logs: list[tuple[str, str | None, DataFrame]]) -> DataFrame:
    """Events of several logs (path, package, events), each path once: a root log that is a member's own counts as the member's."""
    out, seen = None, set()
    for path, package, events in logs:
        if path not in seen:
            seen.add(path)
            own = events.withColumn("package", F.lit(package).cast("string"))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no logs")
    return out


def data_as_of(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.max("updated_at").alias("as_of"))


def push_guard(remote: DataFrame, own: DataFrame, force: bool = False) -> DataFrame:
    """One row: what a push of `own` would do to `remote` (record_id, digest), and whether it may: never if records would go or
    fewer would be left, unless it is forced; never if nothing changes."""
    diff = quality.snapshot_diff(remote, own).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    sizes = remote.agg(F.count(F.lit(1)).alias("remote_records")).crossJoin(own.agg(F.count(F.lit(1)).alias("own_records")))
    rows = sizes.crossJoin(diff)  # a row each
    shrinks = (F.col("removed") > 0) | (F.col("own_records") < F.col("remote_records"))
    moves = F.col("added") + F.col("removed") + F.col("changed") > 0
    return rows.withColumn("shrinks", shrinks).withColumn("allowed", moves & (~shrinks | F.lit(force)))


def store_audit(corpus: DataFrame, files: DataFrame, leaks: Column) -> DataFrame:
    """One row: chunks of files that are gone, files without a chunk, sizes of vectors in use, and texts that redaction would still change."""
    both = corpus.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).join(files.select("file_path", F.lit(True).alias("there")), "file_path", "full_outer")
    links = both.agg(F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("orphans"), F.count_if(F.col("n").isNull()).alias("unread_files"))
    own = corpus.agg(F.sort_array(F.collect_set(F.size("counts"))).alias("dimensions"), F.count_if(leaks).alias("unredacted"))
    return links.crossJoin(own)  # a row each


# --- rendering


def usage_json(log: DataFrame, price: float) -> DataFrame:
    """The totals of a log as one JSON object: keys in order of the alphabet, ratios with six decimals as strings."""
    t = metrics.totals(log, price)
    six = {"mean_ratio", "mean_top_score", "mean_latency", "helpful_rate"}
    return t.select(F.to_json(F.struct(*[(text.six_decimals(F.col(c)) if c in six else F.col(c).cast("string") if c == "tokens_saved" else F.col(c)).alias(c) for c in sorted(t.columns)])).alias("value"))


def usage_lines(log: DataFrame, price: float) -> DataFrame:
    """The totals of a log as lines of fixed width."""
    rows = [("searches", text.thousands(F.col("searches"))), ("tokens saved", text.thousands(F.col("tokens_saved"))), ("mean saved", F.format_string("%.1f %%", F.col("mean_ratio") * 100)), ("dollars saved", F.format_string("$%.2f", F.col("dollars"))), ("helpful", F.coalesce(F.format_string("%.1f %%", F.col("helpful_rate") * 100), F.lit("-")))]
    lines = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.rpad(F.lit(name), 16, " "), F.lpad(value, 16, " ")).alias("line")) for i, (name, value) in enumerate(rows)])
    return metrics.totals(log, price).select(F.inline(lines))


def relevance_lines(macro: DataFrame) -> DataFrame:
    """A fixed-width line for each backend: cases, precision, recall, reciprocal rank, F1."""
    cells = [F.lpad(text.six_decimals(F.col(c)), 10, " ") for c in ("precision", "recall", "mrr", "f1")]
    return macro.select("backend", F.concat(F.rpad("backend", 10, " "), F.lpad(F.col("cases").cast("string"), 6, " "), *cells).alias("line"))
