"""Other files: DLMC matrices, OpenFOAM meshes, tokens of any text, roofline results, random numbers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions import text as T
from matrixloom.model import SparseFrame


def read_smtx(spark: SparkSession, path: str) -> SparseFrame:
    """Three lines: rows, columns, entries; row pointers; column indexes. All values are 1.0."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    head = [int(x) for x in lines.orderBy("at").first()["value"].replace(",", " ").split()]
    m, n, nnz = head
    three = lines.where(F.trim("value") != "").groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("l"))  # three lines
    arrays = three.select(F.transform(T.words(F.trim(F.col("l")[1]["value"])), lambda x: x.cast("long")).alias("ptr"), F.transform(T.words(F.trim(F.col("l")[2]["value"])), lambda x: x.cast("long")).alias("idx"))
    spans = arrays.select("idx", F.posexplode(F.slice("ptr", 1, m)).alias("row", "a"), "ptr").select(F.col("row").cast("long").alias("row"), F.slice("idx", F.col("a").cast("int") + 1, (F.col("ptr")[F.col("row") + 1] - F.col("a")).cast("int")).alias("cols"))
    return SparseFrame(spans.select("row", F.explode("cols").alias("col")).withColumn("val", F.lit(1.0)), m, n)


def read_openfoam(spark: SparkSession, owner: str, neighbour: str) -> SparseFrame:
    """(owner, neighbour), its mirror image for every internal face, and a unit diagonal."""

    def numbers(path: str) -> tuple[DataFrame, int, int]:
        text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
        note = text.where(F.col("value").contains("nCells:")).select(F.regexp_extract("value", r"nCells:\s*(\d+)", 1).cast("long").alias("c"), F.regexp_extract("value", r"nInternalFaces:\s*(\d+)", 1).cast("long").alias("f")).first()
        start = text.where(F.trim("value") == "(").agg(F.min("at")).first()[0]
        rows = text.where((F.col("at") > start) & F.trim("value").rlike(r"^\d+$")).select(F.trim("value").cast("long").alias("v"), "at")
        return rows, note["c"], note["f"]

    from matrixloom.operators import scan

    (o, cells, faces), (b, _, _) = numbers(owner), numbers(neighbour)
    place = lambda df, name: scan.prefix_count(df, F.shiftright("at", 33), ["at"], "face").where(F.col("face") < faces).select("face", F.col("v").alias(name))
    pairs = place(o, "row").join(place(b, "col"), "face").select("row", "col")
    both = pairs.unionByName(pairs.select(F.col("col").alias("row"), F.col("row").alias("col")))
    diagonal = spark.range(cells).select(F.col("id").alias("row"), F.col("id").alias("col"))
    return SparseFrame(both.unionByName(diagonal).withColumn("val", F.lit(1.0)), cells, cells)


def read_tokens(spark: SparkSession, path: str, kind: str = "word") -> DataFrame:
    """token, one row each: by file, line, word or csv field. Spark unpacks .gz, .bz2 and .zst by itself."""
    if kind == "file":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("token"))
    lines = spark.read.text(path)
    if kind == "line":
        return lines.select(F.col("value").alias("token"))
    return lines.select(F.explode({"word": T.words, "csv": T.csv_fields}[kind]("value")).alias("token"))


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """y, x, r, g, b (0 ... depth), depth: the pixels of P3 (text) and P6 (bytes) images; # begins a comment."""

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                head = re.match(rb"(P[36])" + rb"(?:\s+(?:#[^\n]*\n\s*)*)(\d+)" * 3 + rb"\s", raw)
                if not head:
                    raise ValueError("no P3 or P6 image")
                w, h, depth = (int(x) for x in head.groups()[1:])
                rest = raw[head.end() :]
                if head[1] == b"P3":
                    values = np.array(re.sub(rb"#[^\n]*", b"", rest).split()[: 3 * w * h], np.int64)
                else:
                    values = np.frombuffer(rest, np.uint8 if depth < 256 else ">u2", 3 * w * h).astype(np.int64)
                rgb = values.reshape(h * w, 3)
                yield pd.DataFrame({"y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "depth": depth})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "y long, x long, r long, g long, b long, depth long")


def write_ppm(pixels: DataFrame, path: str, width: int, height: int, depth: int = 255) -> None:
    """A folder of text parts that read as one P3 image in the parts' order: pixels y, x, r, g, b; those not given are white."""
    spark = pixels.sparkSession
    head = spark.createDataFrame([(f"P3\n{width} {height}\n{depth}",)], "value string").coalesce(1)
    text = F.format_string("%d %d %d", *[F.coalesce(c, F.lit(depth)) for c in ("r", "g", "b")])
    known = pixels.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", text.alias("t")))).alias("cells"))  # a row of an image
    white = F.lit(" ".join([str(depth)] * 3))
    rows = spark.range(height).withColumnRenamed("id", "y").join(known, "y", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda x: F.coalesce(F.try_element_at("cells", x), white)), " ")
    head.unionByName(rows.orderBy("y").select(line.alias("value"))).write.mode("overwrite").text(path)


ROOFLINE = "empirical struct<gflops: struct<data: array<array<string>>>, gbytes: struct<data: array<array<string>>>>"


def read_roofline(spark: SparkSession, path: str) -> DataFrame:
    """kind (gflops or gbytes), label, value of a roofline result."""
    raw = spark.read.schema(ROOFLINE).json(path, multiLine=True)
    one = lambda k: raw.select(F.lit(k).alias("kind"), F.explode(f"empirical.{k}.data").alias("d")).select("kind", F.col("d")[0].alias("label"), F.col("d")[1].cast("double").alias("value"))
    return one("gflops").unionByName(one("gbytes"))


def uniform(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.rand(seed) * (high - low) + low


def normal(seed: int, mean: float = 0.0, std: float = 1.0) -> Column:
    return F.randn(seed) * std + mean


def gamma(seed: int, shape: float, scale: float = 1.0, tries: int = 16) -> Column:
    """Marsaglia and Tsang: the first accepted of `tries` draws (all fail less than once in 10^20);
    a shape under 1 is boosted by one and powered down."""
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3
    c = 1 / (9 * d) ** 0.5
    draws = F.array(*[F.struct(F.randn(seed + 2 * i).alias("x"), F.rand(seed + 2 * i + 1).alias("u")) for i in range(tries)])
    v = lambda t: F.pow(1 + c * t["x"], 3)
    good = F.filter(draws, lambda t: (1 + c * t["x"] > 0) & (F.ln(t["u"]) < 0.5 * t["x"] * t["x"] + d - d * v(t) + d * F.ln(F.greatest(v(t), F.lit(1e-300)))))
    drawn = d * v(good[0]) * scale
    return drawn if shape >= 1 else drawn * F.pow(F.rand(seed + 2 * tries), 1 / shape)


def random_permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """old, new: a permutation of 0 ... n - 1, by the rank of random numbers."""
    from matrixloom.operators import scan

    keyed = spark.range(n).select(F.col("id").alias("old"), F.xxhash64("id", F.lit(seed)).alias("r"))
    bucket = F.shiftright("r", 58)
    return scan.prefix_count(keyed, bucket, ["r", "old"], "new").select("old", "new")
