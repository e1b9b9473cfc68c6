"""What the plans must look like at any size."""

import os
import re

import pytest

from matrixloom.model import DenseFrame, SparseFrame
from matrixloom.operators import convert, features, matmul
from matrixloom.plans import planner

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def a(spark):
    return SparseFrame.of(spark.read.parquet(f"{DATA}/lineitem.parquet"), "l_orderkey", "l_partkey", "l_quantity", 1500, 200)


@pytest.fixture(scope="module")
def x(spark):
    return DenseFrame.of(spark.read.parquet(f"{DATA}/part.parquet"), "p_partkey", "p_size", "p_retailprice")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text, table):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if table in m]


def test_spmm_small_side_is_broadcast(a, x):
    text = plan(matmul.spmm(a, x))
    assert "BroadcastHashJoin" in text and "partial_sum" in text and text.count("Exchange hashpartitioning") == 1
    assert read_columns(text, "l_orderkey") == [{"l_orderkey", "l_partkey", "l_quantity"}] and "PushedFilters: [IsNotNull(l_partkey)]" in text


def test_spmm_large_side_is_dealt(spark, a, x):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert planner.choose_spmm(10**9, 2)[0] == "shuffle"
        assert "SortMergeJoin" in plan(matmul.spmm(a, x, dense_rows=10**9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_column_pruning(a):
    assert read_columns(plan(features.row_degrees(a)), "l_orderkey") == [{"l_orderkey"}]
    assert read_columns(plan(convert.quantize_columns(a, 8)), "l_orderkey") == [{"l_orderkey", "l_partkey"}]


@pytest.mark.parametrize("f", [features.cross_row_matches, features.column_distances, features.column_groups, features.row_spans, convert.row_pointers, convert.row_swizzle])
def test_no_pairs_of_everything_and_no_python(a, f):
    text = plan(f(a))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text and "Pandas" not in text


def test_global_orders_gather_only_a_row_a_bucket(a):
    text = plan(convert.row_pointers(a))
    single = text[text.index("Exchange SinglePartition") :]
    assert text.count("Exchange SinglePartition") == 1 and "HashAggregate(keys=[_b" in single[:400]


def test_salted_sum(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = {r["k"]: r["s"] for r in planner.salted_sum(df, ["k"], F.col("v"), 8, s=F.col("v")).collect()}
    assert got == {k: sum(range(k, 1000, 3)) for k in range(3)}
