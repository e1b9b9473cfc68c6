import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, is_query, top):
    out = {}
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    for i, v in rows:
        if is_query(i):
            near = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j) for j, w in rows if j != i)
            out[i] = near[:top]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]


def check(got, want, exact=True):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, near in want.items():
        own = sorted(by.get(q, []))
        assert [x[0] for x in own] == list(range(1, len(near) + 1))
        hits += len({x[1] for x in own} & {j for _, j in near})
        total += len(near)
        if exact:
            assert [x[1] for x in own] == [j for _, j in near]
            assert [x[2] for x in own] == pytest.approx([-s for s, _ in near])
    assert set(by) == {q for q, near in want.items() if near}
    return hits / max(1, total)


def test_all_cells_is_brute_force(spark):
    rows = vectors(300)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [float("inf")] + [1.0] * 7), (1005, [None] + [1.0] * 7), (1020, [1.0] * 4), (None, [1.0] * 8)]
    twins = [(2000 + i, rows[0][1]) for i in range(40)] + [rows[5], rows[5]]
    everything = rows + odd + twins
    got = M.search(frame(spark, everything), F.col("id") % 20 == 0, top=5, share=1.0, k=6, block=64, chunk=8).collect()
    assert check(got, brute(everything, lambda i: i % 20 == 0, 5)) == 1.0


def test_recall(spark):
    rows = vectors(3000, 1)
    got = M.search(frame(spark, rows), F.col("id") % 100 == 0, top=10, share=0.3, least=50, k=16, block=256).collect()
    assert check(got, brute(rows, lambda i: i % 100 == 0, 10), exact=False) >= 0.9


def test_few_and_none(spark):
    got = M.search(frame(spark, vectors(4)), F.col("id") >= 0, top=20).collect()
    assert check(got, brute(vectors(4), lambda i: True, 20)) == 1.0
    assert M.search(frame(spark, []), F.col("id") >= 0).count() == 0
    assert M.search(frame(spark, [(1, None)]), F.col("id") >= 0).count() == 0
    assert M.search(frame(spark, vectors(1)), F.col("id") >= 0).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    codes = M.Codes(rng.normal(size=(500, 8)), 7)
    codes.lay(np.ones(49, np.int64), 10)
    q = rng.normal(size=8)
    walked = codes.walk(q, 49)
    score = (codes.c[0] @ q[:4])[walked // 7] + (codes.c[1] @ q[4:])[walked % 7]
    assert sorted(walked) == list(range(49)) and (np.diff(score) <= 1e-12).all()


def test_cells_over_a_block():
    codes = M.Codes(np.random.default_rng(3).normal(size=(50, 4)), 2)
    codes.lay(np.array([5, 25, 3, 4]), 10)
    assert codes.first.tolist() == [0, 1, 4, 4] and codes.blocks.tolist() == [1, 3, 1, 1]


def clustered(n, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(40, 8))
    return c[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 8))


def test_share_is_learned():
    x, y = clustered(2000), np.random.default_rng(5).normal(size=(2000, 8))
    shares = []
    for v in (x, y):
        codes = M.Codes(v, 16)
        shares.append(M.needed_share(codes, v, 10, 0.95, 100))
        counts = np.bincount(codes.cells(v), minlength=256)
        codes.lay(counts, 512)
        hits = 0
        for i in range(0, 2000, 20):
            s = v @ v[i]
            s[i] = -np.inf
            walked = codes.walk(v[i], int(np.ceil(shares[-1] * 2000)))
            hits += np.isin(codes.cells(v)[np.argsort(-s)[:10]], walked).sum()
        assert hits / 1000 >= 0.9
    assert 2 * shares[0] < shares[1]
    assert M.needed_share(M.Codes(x[:1], 16), x[:1], 10, 0.95) == 1.0


def test_recall_with_learned_share(spark):
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(clustered(3000))]
    got = M.search(frame(spark, rows), F.col("id") % 5 == 0, top=10, k=16, block=500, chunk=200).collect()
    assert check(got, brute(rows, lambda i: i % 5 == 0, 10), exact=False) >= 0.9  # of 600 queries: their recalls have a deviation of 0.23
