"""Result quality: relevance against anchors, spans weighted by tokens, paired tests, A/B cost, integrity checks."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.functions import text

# Phrases by which an answer gives up.
PUNTS = ("i don't know", "i do not know", "i cannot find", "i can't find", "couldn't find", "could not find", "unable to", "no information", "not sure", "cannot determine", "n/a", "no answer")


def anchors(column: Column) -> Column:
    """path, path#kind, #kind, path@a-b or path#kind@a-b as a struct; null fields ask for nothing."""
    shape = r"^([^#@]*)(?:#([^@]+))?(?:@(\d+)-(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(column, shape, i), F.lit(""))
    lo, hi = part(3).cast("long"), part(4).cast("long")
    fine = column.rlike(shape) & (part(1).isNotNull() | part(2).isNotNull()) & (lo.isNull() | (part(1).isNotNull() & (lo >= 1) & (lo <= hi)))
    return F.when(fine, F.struct(part(1).alias("file_path"), part(2).alias("kind"), lo.alias("lo"), hi.alias("hi")))


def hits(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results (q_id, rank, file_path, kind, start_line, end_line) with each anchor (q_id, anchor struct) they meet."""
    pairs = results.join(wanted.select("q_id", "anchor"), "q_id")
    fits = lambda c, a: F.col(f"anchor.{a}").isNull() | (F.col(c) == F.col(f"anchor.{a}"))
    overlap = F.col("anchor.lo").isNull() | ((F.col("end_line") >= F.col("anchor.lo")) & (F.col("start_line") <= F.col("anchor.hi")))
    return pairs.where(fits("file_path", "file_path") & fits("kind", "kind") & overlap)


def scores(results: DataFrame, wanted: DataFrame, cases: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """For each case (q_id, k): precision at k, recall over anchors, reciprocal rank, F1. matched: pairs that meet (q_id, rank,
    anchor), where the caller has its own rule."""
    met = hits(results, wanted) if matched is None else matched
    met = met.join(cases.select("q_id", "k"), "q_id").where(F.col("rank") <= F.col("k"))
    own = met.groupBy("q_id").agg(F.countDistinct("rank").alias("relevant"), F.countDistinct("anchor").alias("found"), F.min("rank").alias("first"))
    asked = wanted.groupBy("q_id").agg(F.countDistinct("anchor").alias("anchors"))
    rows = cases.select("q_id", "k").join(asked, "q_id").join(own, "q_id", "left").na.fill(0, ["relevant", "found"])
    p, r = F.col("relevant") / F.col("k"), F.col("found") / F.col("anchors")
    rows = rows.select("q_id", "k", "relevant", "found", "anchors", p.alias("precision"), r.alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))
    return rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[text.rounded(F.avg(c)).alias(c) for c in ("precision", "recall", "mrr", "f1")], F.count_if(F.col("found") == F.col("anchors")).alias("proven"))


def line_weights(corpus: DataFrame) -> DataFrame:
    """file_path, line, weight: tokens of each line; the first chunk in order owns it."""
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), r"\r?\n")
    rows = corpus.select("ord", "file_path", "start_line", F.posexplode(lines).alias("at", "own"))
    return rows.groupBy("file_path", (F.col("start_line") + F.col("at")).alias("line")).agg(F.min_by(text.token_count(F.col("own")), "ord").alias("weight"))


def span_scores(results: DataFrame, wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """Token precision, recall and intersection over union of retrieved and expected lines, for cases with ranged anchors."""
    want = wanted.where("anchor.lo is not null").select("q_id", F.col("anchor.file_path").alias("file_path"), F.explode(F.sequence("anchor.lo", "anchor.hi")).alias("line")).distinct().withColumn("w", F.lit(True))
    got = results.join(want.select("q_id").distinct(), "q_id", "left_semi").select("q_id", "file_path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().withColumn("g", F.lit(True))
    both = want.join(got, ["q_id", "file_path", "line"], "full_outer").join(weights, ["file_path", "line"], "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    sums = both.groupBy("q_id").agg(total(F.col("w") & F.col("g")).alias("shared"), total(F.col("w")).alias("wanted"), total(F.col("g")).alias("retrieved"), F.sum("weight").alias("united"))
    ratio = lambda a, b: text.rounded(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0))
    return sums.select("q_id", "shared", "united", ratio("shared", "retrieved").alias("token_precision"), ratio("shared", "wanted").alias("token_recall"), ratio("shared", "united").alias("token_iou"))


# --- Student's t


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _settled(a, b, x)


def _settled(a: float, b: float, x: float) -> float:
    """The continued fraction itself, evaluated from its tail."""
    value = 1.0
    for i in range(300, 0, -1):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + step / value
    return 1 / value


def two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def critical(df: float, level: float = 0.95) -> float:
    """The t that level of the distribution lies within: Newton steps from the normal quantile, on the logarithm so that heavy tails converge too."""
    x = math.log(NormalDist().inv_cdf(0.5 + level / 2))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    for _ in range(60):
        t = math.exp(x)
        density = scale * (1 + t * t / df) ** (-(df + 1) / 2)
        # the tail falls with t, so its logarithm is nearly a line in log t
        tail = two_sided(t, df)
        step = math.log(tail / (1 - level)) * tail / (2 * density * t)
        x += max(-2.0, min(2.0, step))
        if abs(step) < 1e-15:
            break
    return math.exp(x)


def paired_test(n: int, mean: float, sd: float, scale: float) -> tuple:
    """t, p, low, high of a mean of n paired differences with the given spread; scale: the largest of them."""
    if n < 2:
        return None, None, None, None
    if sd <= 16 * 2.220446049250313e-16 * max(scale, 0.0):
        return None, float(mean == 0), mean, mean
    error = sd / math.sqrt(n)
    half = critical(n - 1) * error
    return mean / error, two_sided(mean / error, n - 1), mean - half, mean + half


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("t", "p", "low", "high")]))
def t_test(n: pd.Series, mean: pd.Series, sd: pd.Series, scale: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([paired_test(int(a), b, 0.0 if pd.isna(c) else c, d) for a, b, c, d in zip(n, mean, sd, scale)], columns=["t", "p", "low", "high"])


def paired(deltas: DataFrame, *by: str) -> DataFrame:
    """n, mean, t, p and the 95 % interval of delta, by group."""
    own = deltas.groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.max(F.abs("delta")).alias("scale"))
    return own.withColumn("test", t_test("n", "mean", "sd", "scale")).select(*by, "n", "mean", "test.*")


# --- A/B runs


def is_punt(answer: Column) -> Column:
    bare = text.unicode_trim(answer)
    phrases = "|".join(PUNTS)
    return (F.length(F.regexp_replace(bare, f"[{text.BLANK}]", "")) < 3) | F.lower(bare).rlike(f"(?<![a-z0-9])(?:{phrases})(?![a-z0-9])")


def grade(answer: Column, punted: Column, needed: Column) -> Column:
    own = F.lower(answer)
    return F.when(F.coalesce(punted, F.lit(False)) | is_punt(answer), "punt").when(F.forall(needed, lambda n: F.contains(own, F.lower(n))), "correct").otherwise("incorrect")


def graded(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """The last run (by ord) of each known question and condition, with grade and cost."""
    last = runs.groupBy("question_id", "condition").agg(F.max_by(F.struct("answer", "punted", "cost_usd", "subagent_cost_usd"), "ord").alias("r"))
    rows = last.join(questions, last["question_id"] == questions["id"])
    return rows.select("question_id", "condition", grade(F.coalesce("r.answer", F.lit("")), F.col("r.punted"), F.col("must_include")).alias("grade"), (F.coalesce("r.cost_usd", F.lit(0.0)) + F.coalesce("r.subagent_cost_usd", F.lit(0.0))).alias("cost"))


def arms(rows: DataFrame) -> DataFrame:
    right = F.col("grade") == "correct"
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("runs"), F.count_if(right).alias("correct"), F.count_if(F.col("grade") == "incorrect").alias("incorrect"), F.count_if(F.col("grade") == "punt").alias("punts"), F.round(F.coalesce(F.sum(F.when(right, F.col("cost"))), F.lit(0.0)), 2).alias("correct_cost"))


def paired_cost(rows: DataFrame) -> DataFrame:
    """Questions right in both arms: how many, what each arm cost, and the share saved (from unrounded costs)."""
    both = rows.where("grade = 'correct'").groupBy("question_id").pivot("condition", ["off", "on"]).agg(F.first("cost")).where("off is not null and on is not null")
    return both.agg(F.count(F.lit(1)).alias("paired"), F.round(F.coalesce(F.sum("off"), F.lit(0.0)), 2).alias("off_cost"), F.round(F.coalesce(F.sum("on"), F.lit(0.0)), 2).alias("on_cost"), text.rounded(F.when(F.sum("off") > 0, (F.sum("off") - F.sum("on")) / F.sum("off"))).alias("saved"))


# --- integrity


def record_digests(chunks: DataFrame) -> DataFrame:
    """record_id, digest over its contents in order, each with its length."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", F.concat(F.octet_length("content").cast("string"), F.lit(":"), F.col("content")).alias("c"))))
    return chunks.groupBy("record_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["c"]), ""), 256).alias("digest"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """record_id, change (added, removed or changed) between two sets of digests."""
    a, b = old.select("record_id", F.col("digest").alias("a")), new.select("record_id", F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "record_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("record_id", change.alias("change"))


def store_stats(corpus: DataFrame) -> DataFrame:
    """Counts by language, by kind, and over all."""
    return corpus.cube("language", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"), text.rounded(F.avg(text.token_count(F.col("content")))).alias("mean_tokens"), F.grouping_id().cast("int").alias("level")).where("level > 0").drop("level")


def doctor(corpus: DataFrame) -> DataFrame:
    """One row of counts of what a sound store has none of."""
    size = F.size("counts")
    return corpus.agg(F.count(F.lit(1)).alias("chunks"), (F.count(F.lit(1)) - F.countDistinct("chunk_id")).alias("repeated_ids"), F.count_if(F.col("content") == "").alias("empty"), F.count_if(F.col("start_line") > F.col("end_line")).alias("bad_spans"),
                      F.count_if(F.col("chunk_id") != text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"))).alias("bad_ids"), F.count_if(size != 256).alias("bad_vectors"))
