"""Matrix Market files: reading, symmetry and field rules, writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.model import SparseFrame
from matrixloom.operators import scan

FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Header:
    format: str
    field: str
    symmetry: str
    m: int
    n: int
    nnz: int


def read_header(spark: SparkSession, path: str) -> Header:
    """From the banner and the first line that isn't a comment; without a banner: coordinate real general."""
    text = spark.read.text(_first_file(spark, path))
    banner = text.where(F.lower("value").startswith("%%matrixmarket")).select("value").first()
    words = banner[0].lower().split() if banner else ["", "matrix", "coordinate", "real", "general"]
    kind, field, symmetry = words[2:5]
    if kind not in ("coordinate", "array") or field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"not a Matrix Market banner: {' '.join(words)}")
    size = text.where(~F.trim("value").startswith("%") & (F.trim("value") != "")).select("value").first()
    if size is None:
        raise ValueError("no size line")
    sizes = [int(x) for x in size[0].split()]
    if len(sizes) != (3 if kind == "coordinate" else 2):
        raise ValueError(f"a bad size line: {size[0]}")
    return Header(kind, field, symmetry, sizes[0], sizes[1], sizes[2] if kind == "coordinate" else sizes[0] * sizes[1])


def _first_file(spark: SparkSession, path: str) -> str:
    """The file itself, or the first part of a folder: Spark deals the largest first, whatever its name."""
    return min(spark.read.text(path).inputFiles())


def _body(spark: SparkSession, path: str) -> DataFrame:
    """parts, at: the lines after the size line, split; at ascends with a file's lines."""
    name = _first_file(spark, path).rpartition("/")[2]
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    text = text.where(~F.trim("value").startswith("%") & (F.trim("value") != ""))
    first = text.where(F.col("file") == name).agg(F.min("at")).first()[0]
    return text.where(F.col("at") != first).select(F.split(F.trim("value"), r"\s+").alias("parts"), "at")


def read_mtx(spark: SparkSession, path: str, expand: bool = True, check: bool = True) -> tuple[Header, SparseFrame]:
    """Entries from 0. Integers become doubles, complex numbers their size, a pattern's entries 1.0.
    expand adds the other half of a symmetric matrix. A count that isn't the header's is an error."""
    header = read_header(spark, path)
    body = _body(spark, path)
    if check and (found := body.count()) != stored(header):
        raise ValueError(f"{found} entries where the header says {stored(header)}")
    if header.format == "array":
        placed = scan.prefix_count(body, F.shiftright("at", 33), ["at"], "_k")
        k = F.col("_k")
        if header.symmetry == "general":
            rows = placed.withColumns({"row": k % header.m, "col": F.floor(k / header.m)})
        else:  # columns of the lower triangle, one after another
            skip = 1 if header.symmetry == "skew-symmetric" else 0
            starts = [0]
            for j in range(header.n):
                starts.append(starts[-1] + max(0, header.m - j - skip))
            table = spark.createDataFrame([(j, starts[j], starts[j + 1]) for j in range(header.n)], "col long, a long, b long")
            rows = placed.join(F.broadcast(table), (k >= F.col("a")) & (k < F.col("b"))).withColumn("row", k - F.col("a") + F.col("col") + skip)
        first = 0
    else:
        rows = body.withColumns({"row": F.col("parts")[0].cast("long") - 1, "col": F.col("parts")[1].cast("long") - 1})
        first = 2
    number = lambda i: F.col("parts")[i].cast("double")
    if header.field == "pattern":
        val = F.lit(1.0)
    elif header.field == "complex":
        val = F.sqrt(number(first) * number(first) + number(first + 1) * number(first + 1))
    else:
        val = number(first)
    entries = rows.select("row", "col", val.alias("val"))
    if expand and header.symmetry != "general":
        # the size of a complex number is that of its conjugate and of its negative
        minus = header.symmetry == "skew-symmetric" and header.field != "complex"
        entries = entries.unionByName(entries.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (-F.col("val") if minus else F.col("val")).alias("val")))
    return header, SparseFrame(entries, header.m, header.n)


def stored(header: Header) -> int:
    if header.format == "coordinate" or header.symmetry == "general":
        return header.nnz
    half = header.n * (header.n + 1) // 2
    return half - header.n if header.symmetry == "skew-symmetric" else half


def read_complex(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val (struct of re, im) of a complex coordinate file, not expanded."""
    p = F.col("parts")
    return _body(spark, path).select((p[0].cast("long") - 1).alias("row"), (p[1].cast("long") - 1).alias("col"), F.struct(p[2].cast("double").alias("re"), p[3].cast("double").alias("im")).alias("val"))


def write_complex(entries: DataFrame, m: int, n: int, path: str) -> None:
    """entries: row, col, val (struct of re, im)."""
    head = entries.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate complex general\n{m} {n} {entries.count()}",)], "value string")
    line = F.format_string("%d %d %s %s", F.col("row") + 1, F.col("col") + 1, F.col("val.re").cast("string"), F.col("val.im").cast("string"))
    head.coalesce(1).unionByName(entries.select(line.alias("value"))).write.mode("overwrite").text(path)


def write_mtx(a: SparseFrame, path: str, field: str = "real", order: bool = True) -> None:
    """A folder of text parts: the header's part comes first, and the parts' order is that of (row, col)."""
    nnz = a.nnz()
    spark = a.entries.sparkSession
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {field} general\n{a.m} {a.n} {nnz}",)], "value string")
    value = {"real": F.format_string("%d %d %s", F.col("row") + 1, F.col("col") + 1, F.col("val").cast("string")), "integer": F.format_string("%d %d %d", F.col("row") + 1, F.col("col") + 1, F.col("val").cast("long")), "pattern": F.format_string("%d %d", F.col("row") + 1, F.col("col") + 1)}[field]
    body = a.entries.orderBy("row", "col") if order else a.entries
    head.coalesce(1).unionByName(body.select(value.alias("value"))).write.mode("overwrite").text(path)
