"""Every query against its DuckDB twin on the smallest driver tables."""

import math
import os

import pytest

from matrixloom.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return c


def same(x, y):
    if x is None or y is None or x != x or y != y:
        return (x is None or x != x) and (y is None or y != y)
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) or isinstance(y, float) else x == y


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    twin = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    order = {c: i for i, c in enumerate(twin.columns)}
    place = [order[c] for c in df.columns]
    key = lambda row: tuple((v is None or v != v, str(float(v)) if isinstance(v, (int, float)) else str(v)) for v in row)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in place) for r in twin.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_all_embeddings_are_read(spark, tmp_path):
    n = 700
    spark.range(n).selectExpr("id as vec_id", "array_repeat(cast(id as float), 64) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(n).selectExpr("id as event_id", "id as user_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["row"]: r["y"] for r in QUERIES["spmm_embedding_all"](spark, str(tmp_path)).where("c = 0").collect()}
    assert got == {i: i * 10000.0 for i in range(n)}
    assert {r["col"]: r["val"] for r in QUERIES["sddmm_embedding_all"](spark, str(tmp_path)).collect()} == {i: 64 * (i * 10000.0) ** 2 for i in range(n)}
