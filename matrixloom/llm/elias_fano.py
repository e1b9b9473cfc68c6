"""Token-ID output: Elias-Fano encoded document boundaries over a concatenated id array.

Documents are dealt by ranges of doc_id, so a partition's ids follow on those of the partition
before. Each partition is written as segments of at most SEGMENT ids (a longer document is a segment
of its own), by Spark's Parquet writer, whose commits bear lost and repeated tasks. A segment is

    magic "EFD2", u8 bytes of an id, u8 0, u16 0, u32 null doc_ids, i64 least doc_id       (little-endian)
    two Elias-Fano sequences: the documents' ends, and their doc_ids less the least
    the ids

and a sequence of n numbers up to u is

    u32 n, u8 low bits, u8 0, u16 0, u64 u; low bits of each number, packed; high bits in unary,
    packed; u32 position of every SAMPLE-th one among the high bits

That is n (2 + log2(u/n)) bits, about, and select needs no 64-bit table. Reading back asks the
structures for each document's end and doc_id where the segments lie; a row a document is moved.

Defined results: a null text counts as empty and has the end id only; rows of one doc_id are told
apart by their text's hash, so that a hot doc_id is dealt too, and a null doc_id comes first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matrixloom.llm.common import cut, shared_dir, small_batches, table
from matrixloom.llm.tokens import BYTE_LEVEL, encoder

MAGIC, SAMPLE, SEGMENT = b"EFD2", 64, 1 << 21
HEAD, SEQUENCE = struct.Struct("<4sBBHIq"), struct.Struct("<IBBHQ")
SCHEMA = "part long, before long, segment binary"


def pack_sequence(values: list[int]) -> bytes:
    """An ascending sequence of numbers from 0 on, below 2**64."""
    n, u = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    v = np.array(values, np.uint64)
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    return b"".join((SEQUENCE.pack(n, low, 0, 0, u), lows, highs, ones[::SAMPLE].astype("<u4").tobytes()))


class Sequence:
    """A packed sequence at `at` of raw; nothing of it is unpacked until it's asked for."""

    def __init__(self, raw: bytes, at: int):
        self.n, self.low, _, _, u = SEQUENCE.unpack_from(raw, at)
        at += SEQUENCE.size
        self.raw, self.lows = raw, at
        at += -(-self.n * self.low // 8)
        self.highs = at
        at += -(-((u >> self.low) + self.n) // 8) if self.n else 0
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at)
        self.end = at + 4 * len(self.samples)

    def __getitem__(self, i: int) -> int:
        """Select of the i-th one, then the number's low bits."""
        at, left, raw = int(self.samples[i // SAMPLE]), i % SAMPLE, self.raw
        byte = self.highs + at // 8
        window = raw[byte] >> (at % 8) << (at % 8)
        while (k := window.bit_count()) <= left:
            left -= k
            byte += 1
            window = raw[byte]
        for _ in range(left):
            window &= window - 1
        one = (byte - self.highs) * 8 + (window & -window).bit_length() - 1
        bit = i * self.low
        first, last = self.lows + bit // 8, self.lows + (bit + self.low + 7) // 8
        lows = int.from_bytes(raw[first:last], "little") >> (bit % 8) & ((1 << self.low) - 1)
        return one - i << self.low | lows


def pack_segment(keys: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """keys: doc_ids in ascending order, nulls first; sizes: ids of each document; ids: all of them."""
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    head = HEAD.pack(MAGIC, ids.dtype.itemsize, 0, 0, len(keys) - len(known), least)
    return b"".join((head, pack_sequence(np.cumsum(np.asarray(sizes, np.int64)).tolist()), pack_sequence([k - least for k in known]), ids.tobytes()))


class Segment:
    """A packed segment; documents are told by their number in it."""

    def __init__(self, raw: bytes):
        magic, width, _, _, self.nulls, self.least = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("no segment")
        self.ends = Sequence(raw, HEAD.size)
        self.keys = Sequence(raw, self.ends.end)
        self.n = self.ends.n
        self.ids = np.frombuffer(raw, f"<u{width}", self.end(self.n - 1) if self.n else 0, self.keys.end)

    def end(self, i: int) -> int:
        """Ids up to and with document i."""
        return self.ends[i]

    def key(self, i: int) -> int | None:
        """doc_id of document i."""
        return None if i < self.nulls else self.least + self.keys[i - self.nulls]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0 : self.end(i)]


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode and write all documents, in ascending doc_id order."""
    schema = StructType.fromDDL(SCHEMA)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, BYTE_LEVEL)
        end = np.array([end_id], encode.kind)
        part, before, keys, arrays, size = TaskContext.get().partitionId(), 0, [], [], 0

        def segment() -> pa.RecordBatch:
            raw = pack_segment(keys, [len(x) + 1 for x in arrays], np.concatenate([y for x in arrays for y in (x, end)]))
            return pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip((part, before, raw), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                if arrays and size + len(ids) + 1 > SEGMENT:
                    yield segment()
                    before, keys, arrays, size = before + size, [], [], 0
                keys.append(key)
                arrays.append(ids)
                size += len(ids) + 1
        if arrays:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ranges.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    schema = StructType.fromDDL("doc_id long, part long, start long, n_tokens long, ids_crc32 long")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seg, rows, start = Segment(raw), [], 0
                for i in range(seg.n):
                    end = seg.end(i)
                    rows.append((seg.key(i), part, before + start, end - start, zlib.crc32(seg.ids[start:end].astype("<u4").tobytes())))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.read.schema(SCHEMA).parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    rows = cut(files.mapInArrow(run, schema), "read_back")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition written
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(first, "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op5_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = shared_dir(spark, "token_ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    out = read_ids(spark, path)
    small_batches(spark)
    return out
