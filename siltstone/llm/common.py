"""What the operators of this subpackage share: scratch tables, sizes, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How much goes to a Python worker at once; a session that sets its own keeps it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20))}
UNKNOWN = 1 << 60  # bytes; what Catalyst assumes of a size it does not know is above
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def steady(spark: SparkSession) -> None:
    """Bounds the batches that this session's Python workers get, where it has Spark's own defaults."""
    own = spark.sparkContext.getConf()
    for key, (default, value) in BATCHES.items():
        if not own.contains(key) and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, value)


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, so a lost executor costs a
    reread, and partition ids or row positions recorded in the rows stay what they were."""
    spark = df.sparkSession
    steady(spark)
    path, before = scratch(spark, tag), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this job go when it ends, not when the driver collects garbage
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a materialised frame that nothing reads any longer."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what df holds; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, target: int = 8 << 20) -> int:
    """How many shuffle partitions keep each near target bytes of df; never fewer than the session's own, which are
    taken where Catalyst can't tell a size (rows made on the driver)."""
    own, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return own if size >= UNKNOWN else max(own, -(-size // target))


HEAVY = 512  # keys with more than this share of the rows are heavy, so there are at most as many


def meet(left: DataFrame, right: DataFrame, key: str | list[str], rows: int, heavy: list | None = None) -> DataFrame:
    """left joined with right on key, of which right has one row each; rows: how many left has. Keys that hold more than rows / HEAVY rows
    of left, at most HEAVY, reach them by a broadcast of their rows of right, so that no key gathers left in one task. heavy: the values
    of these keys (of the last column of several), where they are known already."""
    keys = [key] if isinstance(key, str) else key
    if heavy is None and rows <= crowd(rows):
        heavy = []  # no key can have as many
    if heavy is None:
        counts = left.groupBy(keys[-1]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd(rows))
        heavy = [r[0] for r in counts.where(F.col(keys[-1]).isNotNull()).collect()]
    if not heavy:
        return left.join(right, keys)
    is_heavy = F.col(keys[-1]).isin(heavy)
    return left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), keys).unionByName(left.where(~is_heavy).join(right.where(~is_heavy), keys))


def crowd(rows: int, least: int = 1 << 16) -> int:
    """More rows than this make a key heavy; least: what a task takes of any key."""
    return max(rows // HEAVY, least)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (Spark compares them without case), made from these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def running_sum(df: DataFrame, value: str, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Adds the sum of value over the rows before this one in its group, in two levels: within (group, bucket)
    and over the buckets of a group, in ascending order of bucket. No group is sorted as a whole, so one that
    holds a third of all rows spreads over its buckets."""
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, bucket]
    bases = df.groupBy(*keys).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
    bases = bases.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inner = df.withColumn("_part", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(bases, on=[c for c in same], how="left")
    return joined.withColumn(name, F.col("_part") + F.col("_base")).drop("_part", "_base", *[f"_k{i}" for i in range(len(keys))])
