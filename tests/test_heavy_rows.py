"""Rows that hold most of the entries are worked on in parts, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from matrixloom.model import SparseFrame
from matrixloom.operators import convert, features

M, N = 9, 4000


def cells() -> list[tuple[int, int]]:
    rng = random.Random(3)
    out = [(4, c) for c in range(100, N) if rng.random() < 0.4 or 1000 <= c < 1600]  # a run over many parts
    out += [(4, 777)] * 3 + [(4, 100), (4, N - 1)]  # repeated cells
    out += [(r, rng.randrange(N)) for r in (0, 1, 3, 7) for _ in range(20)]
    out += [(5, c) for c in range(0, 40)]
    return out


def by_hand(window: int, gap: int):
    rows: dict[int, list[int]] = {}
    for r, c in cells():
        rows.setdefault(r, []).append(c)
    walked = []
    for r, cols in rows.items():
        cols.sort()
        run = start = 0
        for i, c in enumerate(cols):
            before = c - cols[i - 1] if i else None
            after = cols[i + 1] - c if i + 1 < len(cols) else None
            if before is None or before > gap + 1:
                run, start = run + 1, i + 1
            walked.append((r, c, before, after, sum(abs(x - c) <= window for x in cols) - 1, i + 1, run, start))
    return sorted(walked, key=lambda t: (t[0], t[5]))


@pytest.fixture(scope="module")
def a(spark):
    return SparseFrame.of(spark.createDataFrame(cells(), "row long, col long").withColumn("val", F.lit(1.0)), "row", "col", "val", M, N)


@pytest.fixture(params=[features.HEAVY, 30])
def heavy(request, monkeypatch):
    monkeypatch.setattr(features, "HEAVY", request.param)
    return request.param


@pytest.mark.parametrize("window,gap", [(0, 0), (1, 1), (40, 5)])
def test_walk(a, heavy, window, gap):
    got = sorted((tuple(r) for r in features.walk(a, window, gap).collect()), key=lambda t: (t[0], t[5]))
    assert got == by_hand(window, gap)


def test_tables_by_row(a, heavy):
    walked = by_hand(0, 0)
    runs = {}
    for r, _, _, after, _, at, run, start in walked:
        runs[r, run] = (at - start + 1, after)
    groups = features.column_groups(a, 0).collect()
    assert {(g["row"], g["group"]): g["size"] for g in groups} == {k: v[0] for k, v in runs.items()} and len(groups) == len(runs)
    order = sorted(cells())
    steps = [abs(b[1] - x[1]) for x, b in zip(order, order[1:])] + [0]
    got = features.column_distances(a).collect()
    assert sorted((r["row"], r["col"], r["distance"]) for r in got) == sorted((*x, d) for x, d in zip(order, steps))
    lasts = {k: v[1] for k, v in runs.items() if v[1] is not None}
    assert all(g["distance"] == lasts[g["row"], g["group"]] for g in groups if (g["row"], g["group"]) in lasts)
    chunks = convert.row_chunks(a, 7).groupBy("row").agg(F.sum("entries").alias("n"), F.max("entries").alias("most")).collect()
    assert {r["row"]: r["n"] for r in chunks} == {r: sum(x == r for x, _ in order) for r in range(M)} and max(r["most"] for r in chunks) == 7


def test_features_do_not_depend_on_parts(a, monkeypatch):
    whole = features.matrix_features(a, 3, 2).first().asDict()
    monkeypatch.setattr(features, "HEAVY", 30)
    split = features.matrix_features(a, 3, 2).first().asDict()
    assert split == pytest.approx(whole)


def test_no_part_holds_a_heavy_row(a, monkeypatch):
    """Of a row with nine tenths of the entries no window sees over 5 %."""
    monkeypatch.setattr(features, "HEAVY", 30)
    parts = features._in_parts(a, features._heavy(a, 0), 0).groupBy("row", "_part").count()
    assert parts.agg(F.max("count")).first()[0] < 0.05 * len(cells())


def test_empty_matrix(spark):
    none = SparseFrame.of(spark.createDataFrame([], "row long, col long, val double"), "row", "col", "val", 3, 4)
    got = features.matrix_features(none).first().asDict()
    assert got["nnz"] == 0 and got["nnz_per_row_max"] == 0 and got["num_groups"] == 0 and got["num_neigh_avg"] is None


@pytest.mark.parametrize("window", [0, 1, 60])
def test_cross_row_matches(a, window):
    rows: dict[int, list[int]] = {}
    for r, c in cells():
        rows.setdefault(r, []).append(c)
    order = sorted(rows)
    want = {r: sum(any(abs(c - x) <= window for x in rows[nxt]) for c in rows[r]) for r, nxt in zip(order, order[1:])} | {order[-1]: 0}
    assert {r["row"]: r["matches"] for r in features.cross_row_matches(a, window).collect()} == want
