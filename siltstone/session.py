"""The Spark settings that every plan of this package assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.ui.enabled": "false",
}


def small_batches(spark: SparkSession, small: bool = True) -> None:
    """Arrow batches of a few MB from now on, as in SETTINGS: a Python worker holds several copies of one. Not small: Spark's own size again, unless
    it is another that the user has set."""
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"]
    if small and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, own)
    elif not small and spark.conf.get(key, None) == own and not spark.sparkContext.getConf().contains(key):
        spark.conf.unset(key)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g", **more: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siltstone")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="siltstone-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs a reread."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
