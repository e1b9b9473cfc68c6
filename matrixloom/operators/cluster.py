"""k-means with given centres, on dense, sparse and binary objects.

The centres (k of them) are literals of the plan; a pass assigns and averages in one job, whose
result, k rows, comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.model import SparseFrame
from matrixloom.operators.matmul import dot


def _distance(vec: Column, centre: list[float], metric: str) -> Column:
    c = F.array(*[F.lit(float(x)) for x in centre])
    if metric == "euclidean":
        return F.aggregate(F.zip_with(vec, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)
    if metric == "cosine":
        size = float(np.linalg.norm(centre)) or 1.0
        return 1 - F.try_divide(dot(vec, c), F.sqrt(dot(vec, vec)) * F.lit(size))
    raise ValueError("metric is euclidean or cosine")


def assign(objects: DataFrame, centres: list[list[float]], metric: str = "euclidean") -> DataFrame:
    """objects: id, vec. Adds cluster; ties go to the lower one."""
    return objects.withColumn("cluster", _cluster(centres, metric))


def kmeans(objects: DataFrame, centres: list[list[float]], metric: str = "euclidean", most_loops: int = 20, threshold: float = 0.0) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's passes until the share of objects that changed is no more than threshold; an empty
    cluster keeps its centre. Returns the centres and the objects with their cluster."""
    dim, last = len(centres[0]), None
    for _ in range(most_loops):
        now = assign(objects, centres, metric)
        if last is not None:
            now = now.withColumn("_was", _cluster(last, metric))
        changed = F.count_if(F.col("cluster") != F.col("_was")) if last is not None else F.count(F.lit(1))
        rows = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), changed.alias("c"), *[F.avg(F.col("vec")[j]).alias(f"m{j}") for j in range(dim)]).collect()  # k rows
        n, moved = sum(r["n"] for r in rows), sum(r["c"] for r in rows)
        last, centres = centres, [list(c) for c in centres]
        for r in rows:
            centres[r["cluster"]] = [r[f"m{j}"] for j in range(dim)]
        if n and moved / n <= threshold:
            break
    return centres, assign(objects, last, metric)


def _cluster(centres: list[list[float]], metric: str) -> Column:
    return F.array_min(F.array(*[F.struct(_distance(F.col("vec"), c, metric).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def sparse_objects(a: SparseFrame) -> DataFrame:
    """Rows of a narrow sparse matrix (n is bounded) as dense objects; rows without entries are zero."""
    maps = a.entries.groupBy("row", "col").agg(F.sum("val").alias("val")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("cells"))
    full = a.rows().join(maps, "row", "left")
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(a.n - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(0.0)))
    return full.select(F.col("row").alias("id"), at.alias("vec"))


def assign_binary(objects: DataFrame, centres: list[int]) -> DataFrame:
    """objects: id, bits (long). The cluster with the fewest differing bits; ties go to the lower one."""
    best = F.array_min(F.array(*[F.struct(F.bit_count(F.col("bits").bitwiseXOR(F.lit(c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return objects.withColumn("cluster", best["i"])


def kmeans_binary(objects: DataFrame, centres: list[int], bits: int = 63, most_loops: int = 20) -> tuple[list[int], DataFrame]:
    """Centres are the bitwise majorities of their objects."""
    for _ in range(most_loops):
        own = assign_binary(objects, centres)
        rows = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(1)).alias(f"b{b}") for b in range(bits)]).collect()  # k rows
        new = list(centres)
        for r in rows:
            new[r["cluster"]] = sum(1 << b for b in range(bits) if 2 * r[f"b{b}"] >= r["n"])
        if new == centres:
            break
        centres = new
    return centres, assign_binary(objects, centres)
