from collections import Counter, defaultdict
import zlib

import pytest

from matrixloom.llm import sharding as S

ROWS = [(i, f"text {i}") for i in range(2000)] + [(None, None), (7, "text 7"), (-5, "ü" * 3000)]


def test_law_and_slots(docs):
    got = S.shard_documents(docs(ROWS, parts=5), [1.0] * 8).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(8))
    text = {(i, t) for i, t in ROWS}
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and text
    assert max(map(len, by.values())) < 1.3 * len(ROWS) / 8
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_same_key_same_shard_anywhere(docs):
    a = {r["doc_id"]: r["shard"] for r in S.shard_documents(docs(ROWS[:500], parts=2), [1.0] * 8).collect()}
    b = {r["doc_id"]: r["shard"] for r in S.shard_documents(docs(ROWS[400:600], parts=7), [1.0] * 8).collect()}
    assert all(a[i] == b[i] for i in range(400, 500))


def test_weights(docs):
    got = Counter(r["shard"] for r in S.shard_documents(docs(ROWS), [3.0, 1.0]).collect())
    assert 0.68 < got[0] / len(ROWS) < 0.82
    with pytest.raises(ValueError):
        S.rendezvous(None, [1.0, 0.0])


def test_empty(docs):
    assert S.shard_documents(docs([]), [1.0] * 8).count() == 0
