"""The golden matrix of FIXTURES.md: values worked out by hand."""

import numpy as np
import pytest

from matrixloom.model import DenseFrame, SparseFrame
from matrixloom.operators import convert, features, matmul

ROW = [0, 0, 0, 2, 2, 2, 3]
COL = [0, 1, 4, 1, 2, 5, 3]


@pytest.fixture(scope="module")
def a(spark):
    rows = [(r, c, float(v)) for r, c, v in zip(ROW, COL, range(1, 8), strict=True)]
    return SparseFrame(spark.createDataFrame(rows, "row long, col long, val double"), 4, 6)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_degrees(a):
    assert column(features.row_degrees(a), "degree", "row") == [3, 0, 3, 1]
    assert column(features.col_degrees(a), "degree", "col") == [1, 2, 1, 1, 1, 1]


def test_spans(a):
    spans = features.row_spans(a)
    assert column(spans, "bandwidth", "row") == [4, 0, 4, 0]
    assert column(spans, "scatter", "row") == [0.75, 0, 0.75, 0]


def test_neighbours(a):
    assert column(features.row_neighbours(a, 1), "neighbours", "row", "col") == [1, 1, 0, 1, 1, 0, 0]


def test_cross_rows(a):
    got = {r["row"]: r["matches"] for r in features.cross_row_matches(a, 1).collect()}
    assert got == {0: 3, 2: 1, 3: 0}
    assert features.cross_row_similarity(a, 1).first()[0] == pytest.approx(4 / 9)


def test_distances_and_groups(a):
    assert column(features.column_distances(a), "distance", "row", "col") == [1, 3, 3, 1, 3, 2, 0]
    groups = features.column_groups(a, 0)
    assert column(groups, "size", "row", "group") == [2, 1, 2, 1, 1]
    assert column(groups, "distance", "row", "group") == [3, 3, 3, 2, 0]
    assert column(features.groups_per_row(a, 0), "groups", "row") == [2, 0, 2, 1]


@pytest.mark.parametrize("distance,expected", [(0, 3), (1, 3), (2, 1)])
def test_distant(a, distance, expected):
    assert features.distant_nonzeros(a, distance).first()[0] == expected


def test_short_rows(a):
    got = features.short_rows(a, 2).first()
    assert (got["rows"], got["nnz"], got["rows_percent"]) == (2, 1, 50.0)


def test_quantize(a):
    got = {(r["row"], r["window"]): r["count"] for r in convert.quantize_columns(a, 2).collect()}
    assert got == {(0, 0): 2, (0, 2): 1, (2, 0): 1, (2, 1): 1, (2, 2): 1, (3, 1): 1}


def test_spmm(spark, a):
    x = DenseFrame(spark.createDataFrame([(i, [2.0 * i + 1, 2.0 * i + 2]) for i in range(6)], "id long, vec array<double>"), 2)
    for f in (lambda: matmul.spmm(a, x, full_rows=True), lambda: matmul.spmm(a, x, dense_rows=10**9, full_rows=True)):
        assert column(f(), "vec", "row") == [[34, 40], [0, 0], [103, 118], [49, 56]]
    assert column(matmul.spmm_kahan(a, x), "vec", "row") == [[34, 40], [103, 118], [49, 56]]


def test_spmm_many_columns(spark, a):
    k = 70  # over one batch of columns
    x = np.arange(6 * k, dtype=float).reshape(6, k)
    dense = DenseFrame(spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "id long, vec array<double>"), k)
    full = np.zeros((4, 6))
    full[ROW, COL] = range(1, 8)
    got = np.array(column(matmul.spmm(a, dense, full_rows=True), "vec", "row"))
    assert np.array_equal(got, full @ x)


def test_sddmm(spark, a):
    u = DenseFrame(spark.createDataFrame([(i, [2.0 * i + 1, 2.0 * i + 2]) for i in range(4)], "id long, vec array<double>"), 2)
    v = DenseFrame(spark.createDataFrame([(i, [2.0 * i + 1, 2.0 * i + 2]) for i in range(6)], "id long, vec array<double>"), 2)
    assert column(matmul.sddmm(a, u, v), "val", "row", "col") == [5, 11, 29, 39, 61, 127, 113]
    assert column(matmul.sddmm(a, u, v, scale=True), "val", "row", "col") == [5, 22, 87, 156, 305, 762, 791]


def test_features_row(a):
    got = features.matrix_features(a).first().asDict()
    assert got["nnz_per_row_avg"] == 1.75 and got["nnz_per_row_std"] == pytest.approx(1.2990381)
    assert got["nnz_per_col_avg"] == pytest.approx(7 / 6) and got["nnz_per_col_std"] == pytest.approx(0.372678)
    assert got["skew"] == pytest.approx(0.7142857) and got["num_neigh_avg"] == pytest.approx(4 / 7)
    assert got["num_groups"] == 5 and (got["m"], got["n"], got["nnz"]) == (4, 6, 7)


def test_transpose_twice(a):
    back = convert.transpose(convert.transpose(a))
    assert sorted(back.entries.collect()) == sorted(a.entries.collect()) and (back.m, back.n) == (4, 6)


def test_upper_entry_is_an_error(a):
    with pytest.raises(Exception, match="above the diagonal"):
        convert.expand_lower(a).entries.collect()
