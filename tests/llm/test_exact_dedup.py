import hashlib

import pytest

from matrixloom.llm import exact_dedup as X

ROWS = [(5, "a b"), (3, "ab"), (9, "a\tb\n"), (1, None), (2, " \x0b"), (None, ""), (7, "c"), (7, "c"), (8, "ä" * 5000), (4, "a b")]


def brute(rows):
    strip = lambda t: "".join(c for c in t or "" if c not in X.BLANKS)
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is not None, i, i))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))[3]
        out.append((i, keep, len(g), keep == i, hashlib.sha256(strip(t).encode()).hexdigest()))
    return out


def test_against_brute_force(docs):
    got = X.exact_dedup(docs(ROWS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(ROWS)))


def test_empty(docs):
    assert X.exact_dedup(docs([])).count() == 0


def test_hot_group(docs):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = {r["doc_id"]: r for r in X.exact_dedup(docs(rows)).collect()}
    assert all(got[i]["keep_id"] == (1 if i % 3 else i) and got[i]["group_size"] == (2000 if i % 3 else 1) for i in got)


def test_index_lives_on(spark, docs, tmp_path):
    first = X.DigestIndex(spark, str(tmp_path / "index"), 4)
    first.append(X.digests(docs([(1, "a"), (2, "b"), (3, "b ")])))
    again = X.DigestIndex(spark, str(tmp_path / "index"))  # as a new session would open it, knowing nothing
    assert again.buckets == 4
    with pytest.raises(ValueError):
        X.DigestIndex(spark, str(tmp_path / "index"), 12)
    again.append(X.digests(docs([(4, "b"), (5, "c"), (6, "a  ")])))
    assert {(r["keep_id"], r["group_size"]) for r in again.rows().collect()} == {(1, 1), (3, 2), (5, 1)}
    plan = X.digests(docs([(9, "z")])).groupBy("text_sha256").count().join(again.rows().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_drop_copies(docs):
    kept = X.drop_copies(docs(ROWS))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["9", "2", "7", "8"])
    assert kept.columns == docs(ROWS).columns
    twice = X.drop_copies(docs([(1, "a"), (2, "a"), (2, "another text")]))
    assert {(r["doc_id"], r["text"]) for r in twice.collect()} == {(1, "a"), (2, "another text")}
    null = X.drop_copies(docs([(None, "a"), (None, "a "), (None, "b"), (3, "a"), (None, "a")]))
    assert sorted(r["text"] for r in null.collect()) == ["a ", "b"]


def test_batches(spark, docs, tmp_path):
    """Texts that an index opened anew knows, one of them hot in the second batch only: no row lost or doubled."""
    path = str(tmp_path / "index")
    X.exact_dedup(docs([(i, f"text {i}") for i in range(2000)]), X.DigestIndex(spark, path, 40)).collect()
    batch = docs([(5000 + i, f"text {i}") for i in range(1000)] + [(9000 + i, "text 3") for i in range(900)] + [(10_000, "new")])
    got = X.exact_dedup(batch, X.DigestIndex(spark, path)).collect()
    assert len(got) == 1901 and {r["doc_id"] for r in got if r["kept"]} == {10_000}
    assert all(r["keep_id"] == int(r["doc_id"] - 5000 if r["doc_id"] < 9000 else 3) for r in got if r["doc_id"] < 10_000)
    assert X.DigestIndex(spark, path).rows().count() == 2001


def test_small_batch_against_a_large_index(spark, docs, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "index"))
    X.exact_dedup(docs([(i, f"text {i // 2}") for i in range(4000)]), index).collect()
    out = X.exact_dedup(docs([(9000 + i, f"text {i}") for i in range(10)]), index)
    sizes = []

    def watch(rows, small, key, count, total):
        sizes.append(small.where(f"{count} > {max(1, total // 1000)}").count())
        return small

    real, X.lookup = X.lookup, lambda *a: watch(*a) and real(*a)
    try:
        assert X.exact_dedup(docs([(9000 + i, f"text {i}") for i in range(10)]), index).count() == 10
    finally:
        X.lookup = real
    assert sizes == [0] and out.count() == 10  # what may be broadcast is of the batch, not of the index


def test_sweep(spark, docs):
    import os

    from matrixloom.llm import common

    X.exact_dedup(docs(ROWS)).collect()
    paths = [p for p in common._named if p.startswith("/")]
    assert paths and any(os.path.isdir(p) for p in paths)
    tables = list(common._tables)
    common.sweep(spark)
    assert tables and not any(spark.catalog.tableExists(t) for t in tables)
    assert not common._named and not any(os.path.isdir(p) for p in paths)
