"""Exact dedup through an extendible-hash index on shared files (DataFrame operations only).

The key of a text is xxhash64 of its normalised form (A-Z lower-cased). The directory starts with one bucket; while a bucket
holds more distinct keys than it may, it is split by the next bit of the key, and the directory doubles when that bucket's depth is its
own. Nothing bounds the depth but the key itself; keys are counted by their leading bits, and again by more bits below
the prefixes where that isn't enough. What a bucket may hold grows with the table (a 2^14th of its distinct keys), so the
directory has some 2^15 slots at any size.

Copies are collapsed in each map task and by their bytes: texts whose keys collide stay separate entries. Entries are dealt to the owner
of their bucket, which chains the entries of a key, and written to the shared folder bucket by bucket. A document looks
itself up by bucket and key; the entries of texts that a 512th of all rows share are broadcast, so those rows don't meet in one task. A chain of one entry is its text, as every document was indexed; in longer chains it finds
its entry by comparing bytes.

Defined cases: null text is the empty text; an empty table gives an empty result; rows that repeat both id and text
share a keeper and all carry kept = true (keep_one keeps one of them); a group whose ids are all null has a null keeper and kept = false; other
columns, whatever their names, pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, crowd, fresh, materialise, meet

ROOM = 20_000  # distinct keys that a bucket may always hold
SHARE = 1 << 14
STEP = 8  # bits by which overfull prefixes are counted further


def directory(count: Callable[[int, int, list[int] | None], dict[int, int]], bits: int, capacity: int) -> list[int]:
    """Slots of an extendible-hash directory: slot (the leading bits of a key) -> bucket.
    count(bits, below, prefixes): distinct keys by so many leading bits, of all or of those with one of these prefixes of `below` bits."""
    known = {bits: count(bits, 0, None)}
    sums: dict[tuple[int, int], int] = {}

    def add(at: int, keys: dict[int, int], down_to: int) -> None:
        for key, n in keys.items():
            for depth in range(down_to, at + 1):
                own = (depth, key >> (at - depth))
                sums[own] = sums.get(own, 0) + n

    add(bits, known[bits], 0)
    leaves, over, deepest = [], [(0, 0)], bits
    while over:
        split, later = over, []
        while split:
            depth, prefix = split.pop()
            if sums.get((depth, prefix), 0) <= capacity or depth == 64:
                leaves.append((depth, prefix))
            elif depth == deepest:
                later.append((depth, prefix))
            else:
                split += [(depth + 1, prefix << 1), (depth + 1, prefix << 1 | 1)]
        if later:
            more = min(64, deepest + STEP)
            add(more, count(more, deepest, [prefix for _, prefix in later]), deepest + 1)
            deepest = more
        over = later
    depth = max(d for d, _ in leaves)
    slots = [0] * (1 << depth)
    for bucket, (own, prefix) in enumerate(sorted(leaves, key=lambda x: x[1] << (64 - x[0]))):
        first = prefix << (depth - own)
        slots[first : first + (1 << (depth - own))] = [bucket] * (1 << (depth - own))
    return slots


def _prefix(key: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit key as a number from 0 (below 2^63)."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _key(norm: Column, key_bits: int) -> Column:
    key = F.xxhash64(norm)
    return key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)


def place(docs: DataFrame, text_col: str, capacity: int | None, key_bits: int) -> tuple[Callable[[Column], Column], int]:
    """The bucket of a key, and the number of buckets."""
    keys = materialise(docs.select(_key(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), key_bits).alias("key")).distinct(), "exact-keys")
    total = keys.count()
    room = capacity or max(ROOM, total // SHARE)

    def count(bits: int, below: int, prefixes: list[int] | None) -> dict[int, int]:
        own = keys if prefixes is None else keys.where(_prefix(F.col("key"), below).isin(prefixes))
        return {r["prefix"]: r["n"] for r in own.groupBy(_prefix(F.col("key"), bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()}  # some 16 a bucket

    slots = directory(count, min(20, (total // room).bit_length() + 4), room)
    depth = len(slots).bit_length() - 1
    held = F.from_json(F.lit(str(slots)), "array<int>")
    return lambda key: F.element_at(held, _prefix(key, depth).cast("int") + 1), slots[-1] + 1


def index(docs: DataFrame, bucket: Callable[[Column], Column], buckets: int, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """The index table: bucket, key, link (place in the chain of its key), chain (entries in it), sha, keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.withColumn("key", _key(F.col("norm"), key_bits)).withColumn("bucket", bucket(F.col("key")))
    entries = rows.groupBy("bucket", "key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select("bucket", "key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16)
    chain = Window.partitionBy("bucket", "key")
    owned = entries.repartition(owners, "bucket").withColumn("link", F.row_number().over(chain.orderBy("sha"))).withColumn("chain", F.count(F.lit(1)).over(chain))
    return materialise(owned.sortWithinPartitions("bucket", "key"), "exact-index")


def look_up(docs: DataFrame, id_col: str, text_col: str, capacity: int | None, key_bits: int) -> tuple[DataFrame, list[str]]:
    """docs with bucket, key, sha, keep_id, group_size of each row, under names of which none clashes."""
    bucket, buckets = place(docs, text_col, capacity, key_bits)
    found = index(docs, bucket, buckets, id_col, text_col, key_bits)
    names = fresh(docs, "bucket", "key", "sha", "keep_id", "group_size", "norm")
    b, k, sha, keep, size, norm = names
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn(k, _key(text, key_bits)).withColumn(b, bucket(F.col(k)))
    hold = lambda df: df.select(F.col("bucket").alias(b), F.col("key").alias(k), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    total = found.agg(F.sum("group_size")).first()[0] or 0
    heavy = [r["key"] for r in found.where((F.col("chain") == 1) & (F.col("group_size") > crowd(total, 1 << 12))).select("key").collect()]  # texts of a 512th of all rows and more
    out = meet(rows.withColumn(sha, F.sha2(text, 256)), hold(found.where("chain = 1")), [b, k], total, heavy)
    chains = found.where("chain > 1").select(F.col("bucket").alias(b), F.col("key").alias(k)).distinct()
    if not chains.isEmpty():  # keys that collide: the few texts of these chains are compared byte by byte
        several = rows.withColumn(norm, text).join(chains, [b, k], "left_semi")
        entries = several.groupBy(b, k, norm).agg(F.max(id_col).alias(keep), F.count(F.lit(1)).alias(size))
        out = out.unionByName(several.join(entries, [b, k, norm]).withColumn(sha, F.sha2(norm, 256)).select(*out.columns))
    return out, names


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """For each row: doc_id, keep_id (largest id of an equal text), group_size, kept, text_sha256."""
    rows, (_, _, sha, keep, size, _) = look_up(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", capacity, key_bits)
    kept = F.coalesce(F.col("doc_id") == F.col(keep), F.lit(False))
    return rows.select("doc_id", F.col(keep).alias("keep_id"), F.col(size).alias("group_size"), kept.alias("kept"), F.col(sha).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group of equal texts one with the largest id."""
    rows, (b, k, sha, keep, size, _) = look_up(docs, id_col, text_col, capacity, key_bits)
    rows = rows.where(F.col(id_col).eqNullSafe(F.col(keep)))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    twins = docs.groupBy(F.col(id_col).alias("id"), _key(text, key_bits).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twins.isEmpty():  # no id comes twice with one key, so each group has one row left
        return rows.select(*docs.columns)
    alone, several = rows.where(F.col(size) == 1), rows.where(F.col(size) > 1).dropDuplicates([b, k, sha])
    return alone.unionByName(several).select(*docs.columns)
