"""What the operators share: the shared folder, cutting lineage, lookups that bear hot keys."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Used where a local session names no shared folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"
#: A key counts as hot if it has over one row in so many; there are no more hot keys than this.
HOT_SHARE = 1000
#: Folders that shared_dir() named in this process, and tables of the catalogue over them.
_named: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        base = DEFAULT_SHARED
    path = f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"
    _named.append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Delete the folders that operators wrote in this process and drop their tables (a table's files in a folder
    that the caller named stay); results that still read them must be saved before."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _named:
        path = spark._jvm.org.apache.hadoop.fs.Path(_named.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from those files,
    so a lost executor costs a file read and not the work before it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named_table(name: str) -> str:
    """Remember a table for sweep()."""
    _tables.append(name)
    return name


def small_batches(spark: SparkSession) -> None:
    """Long texts: no Arrow batch that Python gets holds over 16 MB or 1000 rows (but one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' keys, as longs that never pass through floating point, and the columns of `schema`: make() is called
    once in each task and gives a function from texts (None: null) to columns."""
    full = StructType.fromDDL(", ".join([*(f"{k} long" for k in keys), schema]))
    kinds, n = to_arrow_schema(full), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = f(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(out[x.name], x.type) for x in list(kinds)[n:])], schema=kinds)

    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").alias("text")).mapInArrow(run, full)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows whose text passes, with all their columns as they are: batches are cut in Arrow, so that no type changes."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield batch.filter(pa.array(f(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def lookup(rows: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows inner join small on key, where small has one row for each key and the number of
    rows with that key in `count`. Keys with over total/HOT_SHARE rows are at most HOT_SHARE,
    so they may be broadcast; all others are dealt by key, where none is hot."""
    least = max(1, total // HOT_SHARE)
    hot = F.broadcast(small.where(F.col(count) > least).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot.select(key, "_hot"), key, "left")
    known = marked.where("_hot").drop("_hot").join(hot.drop("_hot"), key)
    rest = marked.where("_hot is null").drop("_hot").join(small.where(F.col(count) <= least), key)
    return known.unionByName(rest)
