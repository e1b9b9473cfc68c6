"""Value features: what the numbers of a column look like, down to their bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions import bits as B
from matrixloom.operators import scan


def windowed_aggregate(df: DataFrame, index: str, value: str, size: int, inner, outer) -> DataFrame:
    """inner (Column -> aggregate) over each run of `size` indexes, then outer over the runs; one row, `value`."""
    runs = df.groupBy(F.floor(F.col(index) / size).alias("_w")).agg(inner(F.col(value)).alias("v"))
    return runs.agg(outer(F.col("v")).alias("value"))


def closest_pair(df: DataFrame, index: str, value: str) -> DataFrame:
    """One row: gap, left, right (indexes) of the two values that lie nearest; ties go to the smaller values."""
    keyed = df.select(F.col(value).cast("double").alias("v"), F.col(index).alias("i")).withColumn("_p", F.struct("v", "i"))
    near = scan.with_next(keyed, scan.value_bucket(keyed, "v"), ["v", "i"], "_p", "_next").where("_next is not null")
    return near.select((F.col("_next.v") - F.col("v")).alias("gap"), "v", F.col("i").alias("left"), F.col("_next.i").alias("right")).agg(F.min(F.struct("gap", "v", "left", "right")).alias("m")).select("m.gap", "m.left", "m.right")


def sorted_differences(df: DataFrame, value: str) -> DataFrame:
    """v, diff, ratio, relative over the globally sorted values: v - last, |v / last|, |(v - last) / last|;
    0 for the first and where the divisor is 0."""
    v = df.select(F.col(value).cast("double").alias("v")).withColumn("_i", F.monotonically_increasing_id())
    near = scan.with_next(v, scan.value_bucket(v, "v"), ["v", "_i"], "v", "_last", back=True)
    diff, safe = F.col("v") - F.col("_last"), F.col("_last").isNotNull() & (F.col("_last") != 0)
    return near.select("v", F.coalesce(diff, F.lit(0.0)).alias("diff"), F.when(safe, F.abs(F.try_divide("v", "_last"))).otherwise(0.0).alias("ratio"), F.when(safe, F.abs(F.try_divide(diff, F.col("_last")))).otherwise(0.0).alias("relative"))


def _stats(name: str, c: Column) -> list[Column]:
    c = c.cast("double")
    return [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_avg"), F.stddev_pop(c).alias(f"{name}_std")]


def value_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: min, max, avg, std of v, |v| and its exponent; trailing zeros; unique values and unique upper 12 bits."""
    v, u = F.col("v"), F.col("u")
    wide = df.select(F.col(value).cast("double").alias("v")).where("v is not null").withColumn("u", B.raw_bits("v"))
    tz = B.trailing_zeros(u).cast("double")
    return wide.agg(
        F.count(F.lit(1)).alias("n"), *_stats("val", v), *_stats("abs", F.abs(v)), *_stats("exponent", B.exponent(u)), F.avg(tz).alias("tz_avg"), F.stddev_pop(tz).alias("tz_std"),
        F.count_distinct("v").alias("unique_values"), F.count_distinct(B.upper12(u)).alias("unique_upper12"),
    ).withColumns({"unique_fraction": F.col("unique_values") / F.col("n"), "index_bits": B.bit_length(F.col("unique_values")).cast("long")})


def double_bits(df: DataFrame, index: str, value: str) -> DataFrame:
    wide = df.select(index, F.col(value).cast("double").alias("v")).withColumn("u", B.raw_bits("v"))
    u = F.col("u")
    return wide.select(index, "v", B.sign(u).alias("sign"), B.exponent(u).alias("exponent"), B.fraction(u).alias("fraction"), B.upper12(u).alias("upper12"), B.trailing_zeros(u).alias("trailing_zeros"), B.surrounding_zeros(u).alias("surrounding_zeros"))


def neighbour_bit_differences(df: DataFrame, order: str, value: str) -> DataFrame:
    """order, difference (the double of the difference, modulo 2^64, of a value's bits and the last one's), surrounding_zeros."""
    wide = df.select(order, F.col(value).cast("double").alias("v")).withColumn("u", B.raw_bits("v"))
    near = scan.with_next(wide, scan.id_bucket(order), [order], "u", "_last", back=True).where("_last is not null")
    d = near.withColumn("d", B.wrapped_difference(F.col("u"), F.col("_last")))
    return d.select(order, B.from_bits("d").alias("difference"), B.surrounding_zeros(F.col("d")).alias("surrounding_zeros"))


def sorted_subset_differences(df: DataFrame, order: str, value: str, log_sizes: range = range(4, 25), log_large: int = 12) -> DataFrame:
    """log_size, mean_zeros, unique_fraction: blocks of 2^log_size values, sorted and made unique;
    mean surrounding zeros of bit differences, scaled to all values. Blocks of 2^log_large and more are
    made of those of 2^log_large, and sorted in buckets of the value, so that no task sorts a whole one."""
    base = df.select(F.col(order).alias("i"), F.col(value).cast("double").alias("v")).withColumn("u", B.raw_bits("v"))
    keys, count = ["log_size", "block"], F.count(F.lit(1)).alias("n")

    def sized(rows: DataFrame, index: str, sizes: list[int], less: int = 0) -> DataFrame:
        each = rows.withColumn("log_size", F.explode(F.array(*[F.lit(k) for k in sizes])))
        return each.withColumn("block", F.floor(F.col(index) / F.pow(F.lit(2.0), F.col("log_size") - less)))

    def zeros(last: Column) -> Column:
        return B.surrounding_zeros(B.wrapped_difference(F.col("u"), F.coalesce(last, F.lit(0).cast("long")))).alias("zeros")

    found = []
    if small := [k for k in log_sizes if k < log_large]:
        once = sized(base, "i", small).groupBy(*keys, "u").agg(F.first("v").alias("v"), count)
        found.append(once.select("log_size", "n", zeros(F.lag("u").over(Window.partitionBy(*keys).orderBy("v", "u")))))
    if large := [k for k in log_sizes if k >= log_large]:
        part = base.groupBy(F.floor(F.col("i") / (1 << log_large)).alias("p"), "u").agg(F.first("v").alias("v"), count)
        once = sized(part, "p", large, log_large).groupBy(*keys, "u").agg(F.first("v").alias("v"), F.sum("n").alias("n")).withColumn("_b", scan.value_bucket(base, "v"))
        own = Window.partitionBy(*keys, "_b").orderBy("v", "u")
        tops = once.groupBy(*keys, "_b").agg(F.max(F.struct("v", "u")).alias("_top"))
        beyond = tops.select(*keys, "_b", F.lag(F.col("_top")["u"]).over(Window.partitionBy(*keys).orderBy("_b")).alias("_beyond"))  # a row for each bucket
        near = once.withColumns({"_near": F.lag("u").over(own), "_edge": F.row_number().over(own) == 1}).join(beyond, [*keys, "_b"])
        found.append(near.select("log_size", "n", zeros(F.when(F.col("_edge"), F.col("_beyond")).otherwise(F.col("_near")))))
    d = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    sums = d.groupBy("log_size").agg(F.avg("zeros").alias("zeros"), F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all"))
    return sums.select("log_size", (F.col("zeros") * F.col("all") / F.col("kept")).alias("mean_zeros"), (F.col("kept") / F.col("all")).alias("unique_fraction"))


def ctz_windows(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """One row, mean_ctz_min: each block's least trailing zeros, weighed by its length."""
    wide = df.select(F.col(order).alias("i"), F.col(value).cast("double").alias("v")).withColumn("tz", B.trailing_zeros(B.raw_bits("v")))
    runs = wide.groupBy(F.floor(F.col("i") / size).alias("w")).agg(F.min("tz").alias("least"), F.count(F.lit(1)).alias("n"))
    return runs.agg((F.sum(F.col("least") * F.col("n")) / F.sum("n")).alias("mean_ctz_min"))


def bit_means(df: DataFrame, value: str, bits: int = 64) -> DataFrame:
    """One row, majority: each bit is set if at least half of the rows have it."""
    c = F.col(value).cast("long")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned(c, b).bitwiseAND(1)).alias(f"b{b}") for b in range(bits)])
    total = F.lit(0).cast("long")
    for b in range(bits):
        total = total.bitwiseOR(F.when(2 * F.col(f"b{b}") >= F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(total.alias("majority"))


def cluster_centre_distances(df: DataFrame, value: str, log_centres: int) -> DataFrame:
    """v, centre, distance: nearest of 2^log_centres centres, which lie at equal shares of the sorted values' sum."""
    v = df.select(F.col(value).cast("double").alias("v")).withColumn("_i", F.monotonically_increasing_id()).withColumn("_a", F.abs("v"))
    n = 1 << log_centres
    total = v.agg(F.sum("_a")).first()[0] or 1.0
    summed = scan.prefix_sum(v, scan.value_bucket(v, "v"), ["v", "_i"], "_a", "_s")
    share = F.least(F.floor(F.col("_s") * n / F.lit(total)), F.lit(n - 1))
    centres = [r["c"] for r in summed.groupBy(share.alias("g")).agg(F.avg("v").alias("c")).orderBy("c").collect()]  # n at most
    listed = F.array(*[F.lit(c) for c in centres])
    near = F.array_min(F.transform(listed, lambda c: F.struct(F.abs(F.col("v") - c).alias("distance"), c.alias("centre"))))
    return v.select("v", near.alias("m")).select("v", "m.centre", "m.distance")
