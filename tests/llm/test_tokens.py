import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from matrixloom.llm import bpe, elias_fano, packing, tokens

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = bpe.ByteBPE(RANKS, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(alphabet=st.sampled_from(list("abcdeERST 'sdtl1290\n\t.,!-_éßŒ²日\x1c\x85\xa0́😀<|>")), max_size=120)
ROWS = [(3, "The quick brown fox, don't you know?"), (1, None), (2, ""), (2, "again two"), (9, "naïve 日本 <|endoftext|>"), (4, "x" * 3000 + " word" * 3000), (None, "no id"), (7, "same"), (8, "same"), (5, "!?" * 5000)]


def library(name):
    t = tokenizers.Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_bpe_is_tiktokens(text):
    ids = next(OWN.encode_batch([text]))
    assert ids == TIK.encode_ordinary(text) and OWN.decode(ids) == text.encode()


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=2, max_size=700))
def test_matrix_and_heap_agree(raw):
    assert OWN.merge_matrix([raw, b"ab"])[0] == OWN.merge_long(raw)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_library_ids(text):
    for name, pattern in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_END)):
        assert tokens.encoder(P.path(name), pattern).encode(text).tolist() == library(name).encode(text, add_special_tokens=False).ids


def test_patterns_are_the_vocabularies():
    assert "ByteLevel" in str(library("byte_bpe_50k.json").pre_tokenizer)
    assert json.load(open(P.path("word_bpe_49k.json")))["normalizer"]["normalizers"][0]["type"] == "NFC"


def test_bpe_query(docs):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(ROWS)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in ROWS:
        ids = TIK.encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want
    assert {bytes(r["decoded"]) for r in bpe.encode(docs(ROWS)).collect()} == {(t or "").encode() for _, t in ROWS}
    assert bpe.digests(docs([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=200), st.integers(0, 2**31))
def test_segment(sizes, seed):
    ids = np.random.default_rng(seed).integers(0, 50000, sum(sizes)).astype("<u2")
    rng = np.random.default_rng(seed)
    keys = [None] * (seed % 3) + sorted(rng.integers(-(2**63), 2**63 - 1, len(sizes)).tolist() if seed % 2 else rng.integers(0, 99, len(sizes)).tolist())
    keys = keys[: len(sizes)]
    seg = elias_fano.Segment(elias_fano.pack_segment(keys, sizes, ids))
    ends = np.cumsum(sizes).tolist()
    assert [seg.end(i) for i in range(len(sizes))] == ends and [seg.key(i) for i in range(len(sizes))] == keys
    assert all(np.array_equal(seg.document(i), ids[e - n : e]) for i, (n, e) in enumerate(zip(sizes, ends, strict=True)))


def test_boundaries_are_small():
    sizes = [300] * 10000
    raw = elias_fano.pack_segment(list(range(0, 10**6, 100)), sizes, np.zeros(3_000_000, "<u2"))
    assert (len(raw) - 6_000_000) * 8 / 10000 < 2 + np.log2(300) + 1 + 2 + np.log2(100) + 1


def test_elias_fano_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(elias_fano, "SEGMENT", 500)
    elias_fano.write_ids(docs(ROWS), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    assert spark.read.parquet(str(tmp_path / "ids")).columns == ["part", "before", "segment"]  # doc_ids and ends are in the segments only
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in elias_fano.read_ids(spark, str(tmp_path / "ids")).collect())
    assert [x[1] for x in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    t = library("byte_bpe_50k.json")
    want = sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in (t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in ROWS))
    assert sorted(x[2:] for x in got) == want


def test_elias_fano_empty(spark, docs, tmp_path):
    elias_fano.write_ids(docs([]), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    assert elias_fano.read_ids(spark, str(tmp_path / "ids")).count() == 0


def check_windows(windows, sizes, window):
    seen = defaultdict(list)
    for pieces in windows:
        total = sum(len(p[3]) for p in pieces)
        assert total == window or total < window and total & (total - 1) == 0
        for doc, start, n, ids in pieces:
            assert n == sizes[doc] and np.array_equal(ids, np.arange(start, start + len(ids)))
            seen[doc].append((start, len(ids)))
    for doc, n in sizes.items():
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=120), st.sampled_from([4, 64]))
def test_packer(lengths, most):
    p, windows = packing.SumOfSquares(64), []
    for i, n in enumerate(lengths):
        windows += list(p.add(i, 0, n, np.arange(n)))
        assert p.n_open == sum(p.count) == sum(map(len, p.open.values()))
        if p.n_open >= most:  # as at the end of a partition: pieces are packed again
            for piece in p.rest():
                windows += list(p.add(*piece))
    windows += list(p.close())
    check_windows(windows, dict(enumerate(lengths)), 64)
    assert sum(len(p[3]) for w in windows for p in w if sum(len(x[3]) for x in w) < 64) < 64  # one rest only


def test_rounds_agree_with_any_split(docs):
    """However finely the input is split, each id lies in one piece and few windows come from closing."""
    rows = [(i, "word " * (i * 37 % 900)) for i in range(400)]
    for parts, again in ((1, 1 << 25), (40, 1 << 25), (40, 20_000)):
        got = packing.pack(docs(rows, parts), P.path("word_bpe_49k.json"), round_ids=again).collect()
        assert sum(r["length"] for r in got) == sum(i * 37 % 900 + 1 for i, _ in rows)
        sizes = defaultdict(int)
        for r in got:
            sizes[r["sequence_id"]] += r["length"]
        assert sum(n < 4096 for n in sizes.values()) <= 12 and all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_level_minimises_squares():
    rng = np.random.default_rng(0)
    p = packing.SumOfSquares(32)
    for _ in range(300):
        p.count = rng.integers(0, 4, 33)
        p.count[0] = p.count[32] = 0
        p.n_open, size = int(p.count.sum()), int(rng.integers(1, 32))

        def after(h):
            c = p.count.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 32
            return int((c**2).sum())

        costs = {h: after(h) for h in range(33 - size) if h == 0 or p.count[h]}
        best = min(costs.values())
        assert costs[p.level(size)] == best


def test_packing_query(docs):
    got = packing.pack(docs(ROWS), P.path("word_bpe_49k.json")).collect()
    t = library("word_bpe_49k.json")
    ids = defaultdict(list)
    for i, x in ROWS:
        ids[i].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    sequences = defaultdict(list)
    for r in got:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in sequences.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1].tolist()] and sum(n for _, n in v) <= 4096
    assert packing.pack(docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_no_segment():
    with pytest.raises(ValueError):
        elias_fano.Segment(b"\0" * 64)
