import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.functions import bits as B
from matrixloom.functions import metrics as M
from matrixloom.functions import text as T
from matrixloom.model import SparseFrame
from matrixloom.operators import cluster, features, hist, matmul, scan, values
from matrixloom.sources import files


def doubles():
    rng = np.random.default_rng(4)
    return np.concatenate(([0.0, -0.0, 1.0, -1.0, 0.1, 1e300, 5e-324, -2.5], rng.normal(size=300) * 10.0 ** rng.integers(-20, 20, 300)))


def test_double_bits(spark):
    v = doubles()
    u = v.view(np.uint64)
    got = values.double_bits(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"), "i", "v").orderBy("i").toPandas()
    assert (got["sign"].to_numpy() == (u >> np.uint64(63))).all()
    assert (got["upper12"].to_numpy() == (u >> np.uint64(52))).all()
    assert (got["fraction"].to_numpy() == (u & np.uint64(2**52 - 1))).all()
    exponent = np.where(v == 0, 0, ((u >> np.uint64(52)) & np.uint64(2047)).astype(np.int64) - 1023)
    assert (got["exponent"].to_numpy() == exponent).all()
    tz = [64 if not x else (int(x) & -int(x)).bit_length() - 1 for x in u]
    lz = [64 - int(x).bit_length() for x in u]
    assert got["trailing_zeros"].tolist() == tz
    assert got["surrounding_zeros"].tolist() == [64 if x == 0 else a + b for x, a, b in zip(u, tz, lz, strict=True)]


def test_wrapped_differences(spark):
    v = doubles()
    u = v.view(np.uint64)
    got = values.neighbour_bit_differences(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"), "i", "v").orderBy("i").toPandas()
    want = (u[1:] - u[:-1]).view(np.float64)
    assert np.array_equal(got["difference"].to_numpy().view(np.uint64), want.view(np.uint64)) or np.array_equal(got["difference"].to_numpy(), want, equal_nan=True)


def test_rotations(spark):
    x = [1, -1, 2**62 + 5, -(2**63)]
    df = spark.createDataFrame([(v,) for v in x], "x long")
    got = df.select(B.rotate_left(F.col("x"), 3).alias("l"), B.rotate_right(F.col("x"), 3).alias("r")).collect()
    turn = lambda v, n: ((v << n | v >> (64 - n)) & (2**64 - 1))
    assert [r["l"] % 2**64 for r in got] == [turn(v % 2**64, 3) for v in x]
    assert [r["r"] % 2**64 for r in got] == [turn(v % 2**64, 61) for v in x]


@pytest.mark.parametrize("method", [m for m in M.METHODS])
def test_quantile_methods(spark, method):
    v = np.random.default_rng(2).normal(size=37)
    qs = [0.0, 0.07, 0.25, 0.5, 0.81, 1.0]
    got = M.quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", qs, method).orderBy("q").toPandas()
    assert got["value"].to_numpy() == pytest.approx(np.quantile(v, qs, method=method))


def test_quantile_compat(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10)], "v double")
    value = lambda **k: [r["value"] for r in M.quantiles(df, "v", [0.25, 0.5], "linear", **k).orderBy("q").collect()]
    assert value() == [1.75, 3.0] and value(compat=True) == [3.0, 4.0]


def test_errors(spark):
    rng = np.random.default_rng(3)
    a, f = rng.normal(size=50), rng.normal(size=50)
    f[:3] = a[:3]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, f, strict=True)], "a double, f double")
    got = df.agg(M.mare("a", "f"), M.smape("a", "f"), M.q_error("a", "f"), M.ln_q_error("a", "f"), M.smlare("a", "f")).first()
    e = np.abs(a - f)
    want = [np.mean(e / np.abs(a)), 100 * np.mean(e / (np.abs(a) + np.abs(f))), np.mean(np.where(e <= 2 * M.EPS, 1, np.abs(f / a))), np.mean(np.log10(np.abs(f)) - np.log10(np.abs(a))), np.mean(np.log10((e + M.EPS) / (np.abs(a) + np.abs(f) + M.EPS)))]
    assert list(got) == pytest.approx(want)


def test_scans(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 9, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i long, v long").repartition(7)
    at = lambda **k: [r["s"] for r in scan.prefix_sum(df, scan.id_bucket("i", 64), ["i"], "v", "s", **k).orderBy("i").collect()]
    assert at() == (np.cumsum(v) - v).tolist() and at(exclusive=False) == np.cumsum(v).tolist()
    assert at(backward=True) == (v.sum() - np.cumsum(v)).tolist()
    near = [r["n"] for r in scan.with_next(df, scan.id_bucket("i", 64), ["i"], "v", "n").orderBy("i").collect()]
    assert near == [*v[1:].tolist(), None]
    back = [r["n"] for r in scan.with_next(df, scan.id_bucket("i", 64), ["i"], "v", "n", back=True).orderBy("i").collect()]
    assert back == [None, *v[:-1].tolist()]
    parts = scan.even_parts(df.select("i"), scan.id_bucket("i", 64), ["i"], 7).groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [71, 71, 71, 71, 72, 72, 72]


def test_kmeans(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 5, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    start = [x[0].tolist(), x[50].tolist(), x[100].tolist(), [99.0, 99.0]]
    centres, own = cluster.kmeans(df, start)
    got = [r["cluster"] for r in own.orderBy("id").collect()]
    assert got == [0] * 40 + [1] * 40 + [2] * 40
    assert np.allclose(centres[1], x[40:80].mean(0)) and centres[3] == [99.0, 99.0]
    assert cluster.assign(df, [[1.0, 0.0], [1.0, 1.0]], "cosine").count() == 120


def test_kmeans_sparse_and_binary(spark):
    a = SparseFrame(spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (1, 1, 3.0)], "row long, col long, val double"), 3, 2)
    assert [r["vec"] for r in cluster.sparse_objects(a).orderBy("id").collect()] == [[1, 0], [0, 5], [0, 0]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([0b1111, 0b1110, 0b0001, 0b0000])], "id long, bits long")
    centres, own = cluster.kmeans_binary(df, [0b1100, 0], 8)
    assert [r["cluster"] for r in own.orderBy("id").collect()] == [0, 0, 1, 1] and centres == [0b1111, 0b0001]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 5, 10)], "v double")
    got = hist.histogram(df, "v", 5).orderBy("x").collect()
    assert [(r["x"], r["count"], r["percent"]) for r in got] == [(0, 3, 60), (2, 0, 0), (4, 1, 20), (6, 0, 0), (8, 1, 20)]
    whole = hist.integer_histogram(df, "v", cumulative=True).orderBy("x").collect()
    assert [r["count"] for r in whole] == [1, 3, 3, 3, 3, 4, 4, 4, 4, 4, 5]


def test_empty_matrix(spark):
    a = SparseFrame(spark.createDataFrame([], "row long, col long, val double"), 3, 2)
    assert [r["degree"] for r in features.row_degrees(a).collect()] == [0, 0, 0]
    assert features.column_distances(a).count() == 0 and features.cross_row_matches(a).count() == 0


def test_random_sources(spark):
    p = [r["new"] for r in files.random_permutation(spark, 100, 5).orderBy("old").collect()]
    assert sorted(p) == list(range(100)) and p != list(range(100))
    g = spark.range(4000).select(files.gamma(1, 3.0, 2.0).alias("g")).agg(F.avg("g"), F.var_pop("g"), F.count("g")).first()
    assert g[0] == pytest.approx(6, rel=0.1) and g[1] == pytest.approx(12, rel=0.2) and g[2] == 4000


def test_windowed_and_bits(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(20)], "i long, v double")
    assert values.windowed_aggregate(df, "i", "v", 5, F.sum, F.max).first()[0] == max(sum(i % 7 for i in range(s, s + 5)) for s in (0, 5, 10, 15))
    assert values.bit_means(spark.createDataFrame([(1,), (3,), (2,)], "v long"), "v", 8).first()[0] == 3
    gap = values.closest_pair(spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 5.5), (3, 9.0)], "i long, v double"), "i", "v").first()
    assert (gap["gap"], gap["left"], gap["right"]) == (0.5, 0, 2)


def test_text_functions(spark):
    df = spark.createDataFrame([("/a/b.c/d.tar.gz",), (".x",), ("n",)], "p string")
    got = df.select(T.path_head("p"), T.path_tail("p"), T.path_ext("p"), T.strip_ext("p")).collect()
    assert [tuple(r) for r in got] == [("/a/b.c", "d.tar.gz", ".gz", "/a/b.c/d.tar"), ("", ".x", "", ".x"), ("", "n", "", "n")]


def test_size_gate(spark):
    df = spark.range(10)
    assert matmul.enough(df, 9).count() == 10 and matmul.enough(df, 10).count() == 0


def test_sorted_subset_differences_of_all_sizes(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=9000), 3)
    got = {r["log_size"]: r for r in values.sorted_subset_differences(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"), "i", "v").collect()}
    assert sorted(got) == list(range(4, 25))

    def zeros(x):
        return 64 if not x else 64 - x.bit_length() + (x & -x).bit_length() - 1

    for k in (4, 11, 12, 13, 24):
        found = []
        for at in range(0, len(v), 1 << k):
            bits = sorted(set(v[at : at + (1 << k)].view(np.uint64).tolist()), key=lambda b: (np.uint64(b).view(np.float64), np.uint64(b).view(np.int64)))
            found += [zeros((b - a) % 2**64) for a, b in zip([0, *bits], bits)]
        assert got[k]["unique_fraction"] == pytest.approx(len(found) / len(v))
        assert got[k]["mean_zeros"] == pytest.approx(np.mean(found) * len(v) / len(found))
