"""Stores kept in memory between calls for as long as their files are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, times and lengths of all files below a path; empty if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ()
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return tuple(sorted(out))


class Held:
    """Tables by path. A call whose files have changed releases what was held and loads again."""

    def __init__(self, spark: SparkSession, load: Callable[[str], dict[str, DataFrame]]):
        self.spark, self.load, self.known = spark, load, {}

    def __call__(self, path: str) -> dict[str, DataFrame]:
        now = stamp(self.spark, path)
        if path in self.known and self.known[path][0] == now:
            return self.known[path][1]
        self.release(path)
        tables = {name: table.persist() for name, table in self.load(path).items()}
        self.known[path] = (now, tables)
        return tables

    def release(self, path: str) -> None:
        for table in self.known.pop(path, ((), {}))[1].values():
            table.unpersist()
