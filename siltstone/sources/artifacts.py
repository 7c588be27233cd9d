"""Stores, snapshots and exchange files: what is written, and how a reader knows that it is whole."""

from __future__ import annotations

import hashlib
import json
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from siltstone.session import written

TABLES = ("chunks", "imports", "file_tokens", "meta")


@pandas_udf(StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Base64 of little-endian doubles."""
    import base64

    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f8").tobytes()).decode())


@pandas_udf(ArrayType(DoubleType()))
def decode_vector(codes: pd.Series) -> pd.Series:
    import base64

    return codes.map(lambda c: None if c is None else np.frombuffer(base64.b64decode(c), "<f8"))


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder a table; a job commits whole or not at all."""
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_store(spark: SparkSession, path: str, members: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a store; members prunes partitions of a store written by member."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if _exists(spark, f"{path}/{name}")}
    if members is not None:
        out = {n: t.where(F.col("member").isin(members)) if "member" in t.columns else t for n, t in out.items()}
        missing = set(members) - {r["member"] for r in out["chunks"].select("member").distinct().collect()}
        if missing:
            raise FileNotFoundError(f"no store for members {sorted(missing)}")
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def append_event(spark: SparkSession, path: str, event: dict) -> None:
    """One event more in a log folder."""
    spark.createDataFrame([(json.dumps(event, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def append_decisions(spark: SparkSession, path: str, new: DataFrame, held: DataFrame) -> DataFrame:
    """Adds decisions (id, text, tags, area, ts) whose id is not held yet; returns those."""
    fresh = new.dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti")
    fresh.select(F.to_json(F.struct("id", "text", "tags", "area", "ts")).alias("value")).write.mode("append").text(path)
    return fresh


def save_snapshot(chunks: DataFrame, root: str, snapshot: str, keep: int = 1) -> None:
    """Writes a snapshot, moves the pointer to it, then removes what is superseded."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{root}/snapshot={snapshot}")
    spark.createDataFrame([(snapshot,)], "snapshot string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    p, fs = _path(spark, root)
    held = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("snapshot=")), key=lambda s: s.getModificationTime())
    for status in held[: max(0, len(held) - keep)]:
        if status.getPath().getName() != f"snapshot={snapshot}":
            fs.delete(status.getPath(), True)


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    name = spark.read.parquet(f"{root}/current").first()["snapshot"]
    return spark.read.parquet(f"{root}/snapshot={name}")


FAN = 4096  # lines of a stretch, and digests of a node of the tree


class Order(NamedTuple):
    """The canonical order of lines, without the lines. places: place (from 1), sha. starts: the place before each part. lows: the least key in each."""

    places: DataFrame
    starts: list[int]
    lows: list[tuple]
    n: int


KEY = ["kind_", "a", "b", "c", "sha"]


def artifact_rows(chunks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """kind_, a, b, c, sha (the canonical order: chunks by file_path, start_line, chunk_id, then edges; equal ones by the SHA-256 of their lines), value:
    each row's JSON."""
    body = chunks.withColumn("embedding", encode_vector("embedding")) if "embedding" in chunks.columns else chunks
    rows = body.select(F.lit(0).alias("kind_"), F.col("file_path").alias("a"), F.col("start_line").cast("long").alias("b"), F.col("chunk_id").alias("c"), F.to_json(F.struct(*sorted(body.columns))).alias("value"))
    if edges is not None:
        rows = rows.unionByName(edges.select(F.lit(1).alias("kind_"), F.col("src").alias("a"), F.lit(0).cast("long").alias("b"), F.col("dst").alias("c"), F.to_json(F.struct("src", "dst")).alias("value")))
    return rows.select(*KEY[:4], F.unhex(F.sha2("value", 256)).alias("sha"), "value")


def line_order(chunks: DataFrame, edges: DataFrame | None = None) -> Order:
    """Only keys and digests are range-sorted and digests written; a line's place is its place in its part and the sizes of the parts before it (a
    number and a key a part on the driver), so no task and no window sees them all. The parts are as many as suit the lines."""
    spark, rows = chunks.sparkSession, artifact_rows(chunks, edges)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = own if size >= 1 << 60 else max(own, -(-size // (64 << 20)))
    spot = F.monotonically_increasing_id()  # the part, and the place in it
    nth = spot.bitwiseAND(F.lit((1 << 33) - 1))
    keys = rows.select(*KEY).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    held = written(keys.select("sha", F.shiftright(spot, 33).cast("int").alias("part"), nth.alias("nth"), F.when(nth == 0, F.struct(*KEY)).alias("low")))
    parts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")).orderBy("part").collect()  # a row a part
    starts = [0, *accumulate(r["n"] for r in parts)]
    begin = spark.createDataFrame([(r["part"], at) for r, at in zip(parts, starts)], "part int, start long")
    places = held.join(F.broadcast(begin), "part").select((F.col("start") + F.col("nth") + 1).alias("place"), "sha")
    return Order(places, starts[:-1], [tuple(r["low"]) for r in parts], starts[-1])


def artifact_lines(chunks: DataFrame, edges: DataFrame | None = None, order: Order | None = None) -> DataFrame:
    """place, value: canonical lines, from 1. They are dealt to the parts of their order by halving among the parts' least keys, and sorted there in
    tasks. With an order at hand they are for one reader, who shuffles them; else they are written once and may be read at will."""
    rows, own = artifact_rows(chunks, edges), order or line_order(chunks, edges)
    kinds = {f.name: f.dataType for f in rows.schema}
    lows = F.array(*[F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(KEY, low)]) for low in own.lows])
    starts = F.array(*[F.lit(at).cast("long") for at in own.starts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(own.lows).bit_length())))])
    above = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lows, at + step) <= F.struct(*KEY), at + step).otherwise(at))  # the last part that begins at or before it
    dealt = rows.withColumn("part", above if own.lows else F.lit(0)).repartitionById(max(1, len(own.lows)), "part").sortWithinPartitions("part", *KEY)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = dealt.select((F.get(starts, F.col("part")) + nth + 1 if own.lows else nth + 1).alias("place"), "value")
    return lines if order else written(lines)


def address(lines: DataFrame) -> str:
    """The root of the tree of digests of canonical lines: SHA-256 of each line, then of each FAN digests in order, level by level in tasks,
    until one is left. It depends on the lines and their order alone, not on how they are dealt. lines: place, and value or its digest (sha)."""
    return _root(lines, lines.count())


def _root(lines: DataFrame, n: int) -> str:
    sha = F.col("sha") if "sha" in lines.columns else F.unhex(F.sha2("value", 256))
    level = lines.select((F.col("place") - 1).alias("at"), sha.alias("sha"))
    while n > 1 or n == 0:
        if n == 0:
            return hashlib.sha256(b"").hexdigest()
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sha"))), lambda x: F.lower(F.hex(x["sha"]))), "")
        level = level.groupBy(F.floor(F.col("at") / FAN).alias("up")).agg(F.unhex(F.sha2(joined, 256)).alias("sha")).select(F.col("up").alias("at"), "sha")
        n = -(-n // FAN)
    return hashlib.sha256(level.first()["sha"].hex().encode()).hexdigest()


def order_address(order: Order) -> str:
    """The address of the lines that have this order."""
    return _root(order.places, order.n)


def write_artifact(lines: DataFrame, manifest: dict, path: str, root: str | None = None, n: int | None = None) -> str:
    """Lines as text parts, each behind its place and a tab, written in tasks; then the manifest with their number and address, which makes
    the artifact whole. Returns the address. root, n: address and number, where the order of the lines has told them."""
    root, n = root or address(lines), lines.count() if n is None else n
    lines.select(F.concat(F.col("place").cast("string"), F.lit("\t"), "value")).write.mode("overwrite").text(f"{path}/lines")
    head = json.dumps(manifest | {"checksum": root, "lines": n}, sort_keys=True)
    lines.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return root


def artifact_body(spark: SparkSession, path: str) -> DataFrame:
    """place, value of an artifact's lines, unchecked."""
    raw = spark.read.text(f"{path}/lines")
    cut = F.instr("value", "\t")
    return raw.select(F.substring("value", F.lit(1), cut - 1).try_cast("long").alias("place"), F.substring("value", cut + 1, F.length("value")).alias("value"))


def check_artifact(spark: SparkSession, path: str) -> dict:
    """The manifest with what was found: lines, whole (every place once) and sound (the address is that of the lines)."""
    manifest, body = json.loads(spark.read.text(f"{path}/manifest").first()["value"]), artifact_body(spark, path)
    found = body.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high")).first()
    n = manifest["lines"]
    whole = found["n"] == found["places"] == n and (n == 0 or (found["low"], found["high"]) == (1, n))
    return manifest | {"found": found["n"], "whole": whole, "sound": whole and _root(body, n) == manifest["checksum"]}


def read_artifact(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame]:
    """Manifest and rows of an exchange artifact; its length, places and address must be right."""
    manifest = check_artifact(spark, path)
    if not manifest["sound"]:
        raise ValueError(f"{path}: {manifest['found']} lines do not match the manifest's length and checksum")
    return manifest, artifact_body(spark, path).select("place", F.from_json("value", schema).alias("r")).select("place", "r.*")


def record_sums(chunks: DataFrame) -> DataFrame:
    """record_id, digest: the number of a record's lines and four sums of parts of their hashes; lines of any number add up before they are shuffled."""
    sha = F.sha2(F.to_json(F.struct("start_line", "chunk_id", "content")), 256)
    rows = chunks.select("record_id", *[F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(4)])
    return rows.groupBy("record_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.sum(f"h{i}").cast("string") for i in range(4)]).alias("digest"))


def fingerprint(chunks: DataFrame, config: dict) -> dict:
    """Configuration, counts and an order-free digest of a store (the sum of the hashes of its distinct ids), with a checksum over all of it."""
    ids = chunks.select("chunk_id").distinct().agg(F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).cast("string").alias("ids"))
    found = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(ids.select(F.coalesce("ids", F.lit("0")).alias("ids"))).first()  # one row each
    out = config | {"chunks": found["n"], "store": found["ids"]}
    return out | {"checksum": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()}


def retained(entries: DataFrame, keep: int) -> DataFrame:
    """entries: corpus, key, added. Those that go when each corpus keeps its newest."""
    newest = Window.partitionBy("corpus").orderBy(F.col("added").desc(), F.col("key").desc())
    return entries.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > keep).drop("_n")
