"""Token-id files: an id array for many documents with Elias-Fano encoded boundaries.

A file is a Parquet table of blocks (written by Spark's committer, so a lost task leaves nothing behind). A block
holds consecutive documents in ascending id order: their ids (8 bytes each), the concatenated token ids in 2 bytes each
where the vocabulary allows and 4 otherwise, and the ends of the documents in that array as an Elias-Fano sequence:
the low `width` bits of each end packed, the high bits as a unary bit vector with a sample of every 32nd one's
position. That takes about 3 + log2(ids / documents) bits a document. Readers
find every offset with select(i), which reads a sample and a few bytes after it; the vector is never decoded as a whole. Offsets over all
blocks come from sums of the blocks' totals, by shard and within a shard.

Defined cases: null text is the empty text, of which only the end id is stored; rows with one doc_id stay rows of
their own, in order of a hash of their text; rows without an id come first and read back as null; an empty table makes an
empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import parts, scratch
from siltstone.llm.tokens import encoder

SAMPLE = 32
SCHEMA = "shard int, block int, n_docs long, n_ids long, id_width int, width int, low binary, high binary, samples binary, doc_ids binary, has_id binary, ids binary"


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers."""

    n: int
    width: int
    low: bytes
    high: bytes
    samples: bytes

    def __post_init__(self):
        self._samples = np.frombuffer(self.samples, "<u4")

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return EliasFano(n, width, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(vector, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number, from one sample and the bytes after it."""
        at = int(self._samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = self.high[byte] >> (at % 8) << (at % 8)
        while (here := bits.bit_count()) <= left:
            left, byte = left - here, byte + 1
            if left >= 64 and byte + 32 <= len(self.high):  # 32 bytes at a time while the one is far
                while byte + 32 <= len(self.high) and (wide := int.from_bytes(self.high[byte : byte + 32], "little").bit_count()) <= left:
                    left, byte = left - wide, byte + 32
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        start = i * self.width
        word = int.from_bytes(self.low[start // 8 : (start + self.width + 7) // 8], "little") >> (start % 8)
        return ((one - i) << self.width) | (word & ((1 << self.width) - 1))


def _packer(path: str, kind: str, end_id: int, block_ids: int, block_docs: int):
    def block(shard: int, number: int, docs: list, has: list, ids: list[bytes]) -> dict:
        ends = np.cumsum([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), "<u4")
        width = 2 if not len(flat) or flat.max() < 65536 else 4
        ef = EliasFano.of(ends)
        return {"shard": shard, "block": number, "n_docs": len(docs), "n_ids": len(flat), "id_width": width, "width": ef.width, "low": ef.low, "high": ef.high, "samples": ef.samples,
                "doc_ids": np.asarray(docs, "<i8").tobytes(), "has_id": np.packbits(np.asarray(has, np.uint8)).tobytes(), "ids": flat.astype(f"<u{width}").tobytes()}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, shard, number, end = encoder(path, kind), TaskContext.get().partitionId(), 0, np.asarray([end_id], "<u4").tobytes()
        docs, has, ids, held = [], [], [], 0
        for frame in frames:
            for doc, known, text in zip(frame["id"], frame["has_id"], frame["text"]):
                ids.append(encode(text) + end)
                docs.append(doc)
                has.append(known)
                held += len(ids[-1]) // 4
                if held >= block_ids or len(docs) >= block_docs:
                    yield pd.DataFrame([block(shard, number, docs, has, ids)])
                    docs, has, ids, held, number = [], [], [], 0, number + 1
        if docs:
            yield pd.DataFrame([block(shard, number, docs, has, ids)])

    return pack


def write_ids(docs: DataFrame, target: str, vocabulary: str, kind: str = "word", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 20, block_docs: int = 1 << 16) -> None:
    """Encodes every whole text, appends end_id and writes a token-id file at target, in ascending order of id."""
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("id"), F.col(id_col).isNotNull().alias("has_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id (or of none) spread by a hash of their text
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(parts(docs), "id", "has_id", "mark").sortWithinPartitions("id", "has_id", "mark").drop("mark")
    # shard: the number of a range of ids, so shards in order hold ids in order
    rows.mapInPandas(_packer(vocabulary, kind, end_id, block_ids, block_docs), SCHEMA).write.option("compression", "zstd").parquet(target)


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for b in frame.itertuples():
            boundaries = EliasFano(b.n_docs, b.width, b.low, b.high, b.samples)
            ends = np.fromiter(map(boundaries.select, range(b.n_docs)), np.int64, b.n_docs)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = np.frombuffer(b.ids, f"<u{b.id_width}").astype("<u4")
            known = np.unpackbits(np.frombuffer(b.has_id, np.uint8))[: b.n_docs].astype(bool)
            raw = memoryview(ids.tobytes())
            yield pd.DataFrame({"shard": b.shard, "block": b.block, "doc_id": pd.array(np.frombuffer(b.doc_ids, "<i8"), "Int64").copy() if known.all() else pd.array(np.where(known, np.frombuffer(b.doc_ids, "<i8").astype(object), None), "Int64"),
                                "local": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)]})


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a token-id file."""
    blocks = spark.read.parquet(source)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("block_base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("block_base") + F.col("shard_base")).alias("base"))
    found = blocks.mapInPandas(_unpack, "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["shard", "block"]).select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def through_file(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes a token-id file in the shared folder and reads it back."""
    target = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, target, vocabulary, **options)
    return read_ids(docs.sparkSession, target)
