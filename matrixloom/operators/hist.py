"""Histograms, pixel grids and slices: the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _percent(counts: DataFrame, cumulative: bool) -> DataFrame:
    """x, count to x, count, percent; all bins are in counts, a row each."""
    everything = Window.partitionBy(F.lit(0))
    out = counts.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(everything))
    if cumulative:
        up = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("count", F.sum("count").over(up)).withColumn("percent", F.col("count") * 100.0 / F.max("count").over(everything))
    return out


def integer_histogram(df: DataFrame, column: str, cumulative: bool = False) -> DataFrame:
    """x, count, percent for every whole number from the least to the largest value."""
    counts = df.groupBy(F.col(column).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("count"))
    ends = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null")
    bins = ends.select(F.explode(F.sequence("lo", "hi")).alias("x"))
    return _percent(bins.join(counts, "x", "left").select("x", F.coalesce("count", F.lit(0)).alias("count")), cumulative)


def histogram(df: DataFrame, column: str, bins: int, cumulative: bool = False) -> DataFrame:
    """x (a bin's left edge), count, percent: equal widths from the least to the largest value, which is in the last bin."""
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo is not null").withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("w") > 0, F.least(F.floor((v - F.col("lo")) / F.col("w")), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = edges.join(counts, "bin", "left").select((F.col("lo") + F.col("bin") * F.col("w")).alias("x"), F.coalesce("count", F.lit(0)).alias("count"))
    return _percent(full, cumulative)


def grid(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], x_pixels: int, y_pixels: int, flip: bool = False) -> DataFrame:
    """y_pix, x_pix, count: points on a grid; a pixel is floor((v - least) / step + 0.5)."""

    def pixel(c: str, ends: tuple[float, float], n: int):
        step = (ends[1] - ends[0]) / (n - 1) if n > 1 and ends[1] > ends[0] else 1.0
        return F.floor((F.col(c) - F.lit(float(ends[0]))) / F.lit(step) + 0.5)

    row = pixel(y, y_range, y_pixels)
    return df.groupBy((F.lit(y_pixels - 1) - row if flip else row).alias("y_pix"), pixel(x, x_range, x_pixels).alias("x_pix")).agg(F.count(F.lit(1)).alias("count"))


def bounded_median(df: DataFrame, x: str, y: str, slices: int) -> DataFrame:
    """slice, min, max, avg, q25, q50, q75 of y in each of `slices` equal parts of x's range."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.least(F.floor((F.col(x) - F.col("lo")) * slices / (F.col("hi") - F.col("lo"))), F.lit(slices - 1))
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = df.crossJoin(F.broadcast(ends)).groupBy(at.alias("slice")).agg(F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("avg"), q.alias("q"))
    return own.select("slice", "min", "max", "avg", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
