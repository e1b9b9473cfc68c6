"""Scans over a global order without a window that holds everything.

The order is cut into buckets that ascend with it; a window works in each, and what passes from one
bucket to the next comes from a table of one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a bucket where the order is that of a dense id.
IDS = 1 << 16


def id_bucket(column: str, ids: int = IDS) -> Column:
    return F.floor(F.col(column) / ids)


def value_bucket(df: DataFrame, column: str, buckets: int = 64) -> Column:
    """Ascending buckets of about equal numbers of rows, from approximate quantiles."""
    cuts = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))) if buckets > 1 else []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(column))) if cuts else F.lit(0)


def with_next(df: DataFrame, bucket: Column, order: list[str], value: str, name: str, back: bool = False) -> DataFrame:
    """`name`: the value of the next (back: the last) row in the global order, null at its end."""
    keyed = df.withColumn("_b", bucket)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.col(value).alias("value"))
    edge = keyed.groupBy("_b").agg((F.max if back else F.min)(key).alias("_e"))
    step = F.lag if back else F.lead
    beyond = edge.select("_b", step(F.col("_e")["value"]).over(Window.orderBy("_b")).alias("_beyond"))  # a row for each bucket
    own = Window.partitionBy("_b").orderBy(*order)
    near, at_edge = step(F.col(value)).over(own), step(F.lit(True)).over(own).isNull()
    return keyed.withColumns({"_near": near, "_edge": at_edge}).join(beyond, "_b").withColumn(name, F.when(F.col("_edge"), F.col("_beyond")).otherwise(F.col("_near"))).drop("_b", "_near", "_edge", "_beyond")


def prefix_sum(df: DataFrame, bucket: Column, order: list[str], value: str, name: str, exclusive: bool = True, backward: bool = False) -> DataFrame:
    """`name`: the sum of `value` over all rows before (inclusive: and with) the row in the global
    order; backward: over all rows after it."""
    keyed = df.withColumn("_b", bucket)
    sort = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    over = Window.orderBy(F.col("_b").desc() if backward else F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("_b").agg(F.sum(value).alias("_s")).select("_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_before"))  # a row for each bucket
    own = F.sum(value).over(Window.partitionBy("_b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    return keyed.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, "_b").withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def prefix_count(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """`name`: the row's place, from 0, in the global order."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), bucket, order, "_one", name).drop("_one")


def balanced_parts(df: DataFrame, bucket: Column, order: list[str], work: str, parts: int, name: str = "part", row_cost: float = 0.0) -> DataFrame:
    """Cuts the order where the work before a row (plus row_cost for each) passes equal shares of the total."""
    costed = df.withColumn("_w", (F.col(work) + F.lit(row_cost)).cast("double"))
    total = costed.agg(F.sum("_w")).first()[0] or 1.0
    before = prefix_sum(costed, bucket, order, "_w", "_before_w")
    return before.withColumn(name, F.least(F.floor(F.col("_before_w") * parts / F.lit(float(total))), F.lit(parts - 1)).cast("long")).drop("_w", "_before_w")


def even_parts(df: DataFrame, bucket: Column, order: list[str], parts: int, name: str = "part") -> DataFrame:
    """Parts whose sizes differ by one at most, in the global order; the larger ones come first."""
    total = df.count()
    q, r = divmod(total, parts)
    at = F.col("_at")
    big = F.lit((q + 1) * r)
    placed = prefix_count(df, bucket, order, "_at")
    rest = F.floor((at - big) / F.lit(max(q, 1))) + r
    return placed.withColumn(name, F.when(at < big, F.floor(at / F.lit(q + 1))).otherwise(rest).cast("long")).drop("_at")


def prefix_max(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the largest `value` (null counts as none) of the row and all before it."""
    keyed = df.withColumn("_b", bucket)
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = keyed.groupBy("_b").agg(F.max(value).alias("_m")).select("_b", F.max("_m").over(over).alias("_before"))  # a row for each bucket
    own = F.max(value).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn("_own", own).join(tops, "_b").withColumn(name, F.greatest("_before", "_own")).drop("_b", "_own", "_before")


def as_of(left: DataFrame, right: DataFrame, value: str, name: str, buckets: int = 64) -> DataFrame:
    """left with `name`: the largest `value` of right that is not over the row's own; null if all are.
    A binary search in a sorted column, for columns of any length on both sides."""
    marks = right.select(F.col(value).cast("double").alias("_v")).distinct().select("_v", F.col("_v").alias("_mark"), F.lit(0).alias("_side"))
    rows = left.select(F.col(value).cast("double").alias("_v"), F.lit(None).cast("double").alias("_mark"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    found = prefix_max(both, value_bucket(rows, "_v", buckets), ["_v", "_side"], "_mark", name)
    return found.where("_side = 1").select("_row.*", name)


def bucket_sort(df: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """`name`: the row's place, from 0, in a stable sort by `key`, whose values are few enough for a table of their counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(key, F.coalesce(F.sum("_n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("_at", at).join(starts, key).withColumn(name, F.col("_start") + F.col("_at")).drop("_at", "_start")
