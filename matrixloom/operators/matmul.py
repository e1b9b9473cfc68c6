"""Sparse times dense (spmm) and dense times dense at a sparse matrix's entries (sddmm)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.model import DenseFrame, SparseFrame
from matrixloom.plans.planner import choose_spmm, size_checked


def dot(u: str | Column, v: str | Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def spmm(a: SparseFrame, x: DenseFrame, dense_rows: int | None = None, full_rows: bool = False) -> DataFrame:
    """row, vec: sum over the row's entries of val * x[col]. One sum for each column of x, combined
    before the shuffle, so a heavy row costs a partial row for each task. full_rows adds rows of zeros."""
    strategy, batch = choose_spmm(dense_rows if dense_rows is not None else a.n, x.k)
    out = None
    for start in range(0, x.k, batch):
        part = x.part(start, batch)
        side = F.broadcast(part.data) if strategy == "broadcast" else part.data
        both = a.entries.join(side, a.entries["col"] == side["id"])
        sums = both.groupBy("row").agg(*[F.sum(F.col("val") * F.col("vec")[c]).alias(f"c{start + c}") for c in range(part.k)])
        out = sums if out is None else out.join(sums, "row")
    names = [f"c{c}" for c in range(x.k)]
    if full_rows:
        out = a.rows().join(out, "row", "left").select("row", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    return out.select("row", F.array(*names).alias("vec"))


def spmv(a: SparseFrame, x: DataFrame) -> DataFrame:
    """x: id, x. Returns row, y."""
    return a.entries.join(x, a.entries["col"] == x["id"]).groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def kahan_sum(terms: str | Column) -> Column:
    """Compensated sum of an array in its order."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, t: Column) -> Column:
        y = t - acc["c"]
        total = acc["s"] + y
        return F.struct(total.alias("s"), ((total - acc["s"]) - y).alias("c"))

    return F.aggregate(terms, zero, step, lambda acc: acc["s"])


def spmm_kahan(a: SparseFrame, x: DenseFrame) -> DataFrame:
    """row, vec: the gold result, terms of a row added in column order with compensation. It gathers
    a row's terms, and is meant for checks."""
    terms = a.entries.join(x.data, a.entries["col"] == x.data["id"]).select("row", F.struct("col", "val", "vec").alias("t"))
    rows = terms.groupBy("row").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def products(c: int) -> Column:
        return F.transform("t", lambda t: t["val"] * t["vec"][c])

    return rows.select("row", F.array(*[kahan_sum(products(c)) for c in range(x.k)]).alias("vec"))


def sddmm(a: SparseFrame, u: DenseFrame, v: DenseFrame, u_rows: int | None = None, v_rows: int | None = None, scale: bool = False) -> DataFrame:
    """row, col, val: <u[row], v[col]> at each entry; scale multiplies by the entry's value."""
    left = size_checked(u.data.select(F.col("id").alias("row"), F.col("vec").alias("u")), u_rows if u_rows is not None else a.m, 8 * u.k)
    right = size_checked(v.data.select(F.col("id").alias("col"), F.col("vec").alias("v")), v_rows if v_rows is not None else a.n, 8 * v.k)
    product = dot("u", "v")
    return a.entries.join(left, "row").join(right, "col").select("row", "col", (product * F.col("val") if scale else product).alias("val"))


def max_relative_error(gold: DataFrame, test: DataFrame, keys: list[str], value: str = "val", eps: float = 1e-10) -> DataFrame:
    """One row, max_rel_err: over the entries whose gold is beyond eps in size."""
    g, t = F.col("_g"), F.col("_t")
    both = gold.select(*keys, F.col(value).alias("_g")).join(test.select(*keys, F.col(value).alias("_t")), keys)
    return both.agg(F.max(F.when(F.abs(g) > eps, F.abs(g - t) / F.abs(g))).alias("max_rel_err"))


def squared_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.agg(F.sum(F.pow(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)), 2)).alias("squared_difference"))


def gflops(nnz: Column, k: Column, seconds: Column, iterations: int = 128) -> Column:
    return 2 * nnz * k * iterations / seconds / 1e9


def csr_bytes(nnz: Column, m: Column, value_bytes: int = 8, index_bytes: int = 4) -> Column:
    return nnz * (value_bytes + index_bytes) + (m + 1) * index_bytes


def enough(df: DataFrame, least: int = 200) -> DataFrame:
    """df if it has over `least` rows, else none of it."""
    size = df.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    return df.join(F.broadcast(size), how="left_semi", on=F.lit(True))


def vec_columns(df: DataFrame, k: int, name: str = "y") -> DataFrame:
    """row and one column for each element of vec."""
    return df.select("row", *[F.col("vec")[c].alias(f"{name}{c}") for c in range(k)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
