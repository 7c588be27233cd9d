"""Mixing sources to target weights as a time-varying curriculum.

Targets: a share of all words by weight, held to at most `most` times what a source has; what a source cannot take
goes to the others by weight. With sources in ascending order of cap over weight that is one threshold, found with
windows over the per-source totals (one row a source).

Takes: documents of a source stand in a fixed pseudo-random order (MD5 of id and text). The order is gone through
until the target is reached, a second time where the target exceeds the source; the document at the end is taken
in part. Running sums are two-level, over as many buckets of marks as keep a bucket near BUCKET rows, so a hot source is never sorted as a whole.

Positions: each source has a weight schedule over training time t in [0, 1], a line from 1 - ramp to 1 + ramp.
Its integral is the source's cumulative demand, (1 - g) t + g t^2 of the target; a document's position is the time
at which the demand reaches the words before it. The result is range-sorted by position; sequence() gives whole documents in
that order, where a take in part counts if it is at least half the words, so a source's words miss its target by half of
one document at most.

Defined cases: null text has size 0; size 0 is never taken and has no position; null sources form one source, last
in order; rows that repeat an id count each by itself (of rows that repeat id and text it doesn't matter which is which); a null id orders as the
empty string; other columns, whatever their names, pass through sequence(); an empty table gives an empty result; without words no document is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, fresh, materialise, parts, running_sum

BUCKET = 1 << 16  # rows


def pick(values: Sequence[float], at: Column) -> Column:
    """values[at mod their number]."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, ramps: Sequence[float]) -> DataFrame:
    """source, source_size, target, ramp: one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(by_name) - 1
    rows = totals.withColumn("_at", at).withColumn("_w", pick(weights, F.col("_at"))).withColumn("ramp", pick(ramps, F.col("_at")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    before, onward, every = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    demand = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", demand / F.sum("_w").over(onward))
    first = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_at", "_level"))).over(every)
    rows = rows.withColumn("_first", first)
    target = F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_first._level") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"), "ramp")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, ramps: Sequence[float] = (-0.5, 0.0, 0.5), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, position_again and mark, in order of position.
    position: of the first take; position_again: of the second, where there is one. most: 2 at most. mark: MD5 of id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), marked(F.col(id_col), text).alias("mark")), "mix-sizes")
    digits, rows = 2, sizes.count()
    while 16**digits * BUCKET < rows:
        digits += 1
    rows = running_sum(sizes.withColumn("_bucket", F.substring("mark", 1, digits)), "size", ["source"], "_bucket", [F.col("mark"), F.col("doc_id"), F.col("size")], "_before")
    targets = source_targets(sizes, weights, share, most, ramps).withColumnRenamed("source", "_source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_bucket")
    goal = F.round("target").cast("long")
    part = lambda done: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("_before") - done))
    rows = rows.withColumn("_one", part(F.lit(0))).withColumn("_two", part(F.col("source_size")))
    out = rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_one") + F.col("_two")).alias("taken"),
                      F.when(F.col("_one") > 0, when_reached(F.col("_before"))).alias("position"),
                      F.when(F.col("_two") > 0, when_reached(F.col("_before") + F.col("source_size"))).alias("position_again"), "mark")
    return out.repartitionByRange(parts(sizes), "position", "mark").sortWithinPartitions("position", "mark")


def marked(id_: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them, in order of position."""
    mark, spot, at = fresh(docs, "mark", "spot", "at")
    takes = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    spots = F.filter(F.array(F.when(2 * F.least("taken", "size") >= F.col("size"), F.col("position")), F.when(2 * (F.col("taken") - F.col("size")) >= F.col("size"), F.col("position_again"))), lambda x: x.isNotNull())
    takes = materialise(takes.select(F.col("mark").alias(mark), F.when(F.col("taken") > 0, spots).otherwise(F.array().cast("array<double>")).alias(spot)), "mix-takes")
    rows = docs.withColumn(mark, marked(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    if takes.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows, takes = rows.withColumn(at, F.lit(1)), takes.withColumn(at, F.lit(1))
    else:  # rows that repeat id and text: each take goes to one of them
        nth = F.row_number().over(Window.partitionBy(mark).orderBy(mark))
        rows, takes = rows.withColumn(at, nth), takes.withColumn(at, nth)
    takes = takes.where(F.size(spot) > 0)
    placed = rows.join(takes, [mark, at]).select(*docs.columns, mark, F.explode(spot).alias(spot))
    return placed.repartitionByRange(parts(docs), spot, mark).sortWithinPartitions(spot, mark).select(*docs.columns)


def when_reached(words: Column) -> Column:
    """The time at which a source's cumulative demand is so many words: (1 - g) t + g t^2 = words / target."""
    done, g = words / F.col("target"), F.col("ramp")
    bent = (F.sqrt((1 - g) * (1 - g) + 4 * g * done) - (1 - g)) / (2 * g)
    return F.when(g == 0, done).otherwise(bent + 0.0)
