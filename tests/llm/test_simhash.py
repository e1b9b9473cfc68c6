from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matrixloom.llm import graph, near_dup, simhash


def brute_fingerprint(text, width=3):
    """A-Z lowered, words between ASCII blanks, majority of each bit over all shingles."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


TEXTS = ["", None, "A", "a b", "A B c", "Ä ä É", "x\x85y\xa0z w\x1cv", "one two three four five " * 40, " \x0b\x0c tabs\tand\nlines ", "İstanbul K K", "w " * 300_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_texts_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    for text in TEXTS[:-1]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        assert np.array_equal(np.sort(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(text, 2)])), np.sort(np.concatenate([np.zeros(0, np.uint64), *whole(text, 2)])))


def whole(text, width):
    words = (text or "").encode().lower().split()
    return [simhash.hashes(words, len(words) - width + 1, width)] if len(words) >= width else [simhash.hashes(words, 1, len(words))] if words else []


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def random_prints(n, seed):
    """Balls around a few centres, chains, far ones, top bits set."""
    rng = np.random.default_rng(seed)
    out = [0, 1, 3, 7, 2**63, 2**63 + 1, 2**64 - 1]
    for _ in range(5):
        c = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        out += [c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(n // 6)]
    return out + [int(x) for x in rng.integers(0, 2**63, n // 6)]


@pytest.mark.parametrize("large", [2048, 20])
def test_groups_against_brute_force(spark, monkeypatch, large):
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius=2: real(nodes, radius, large))
    fps = random_prints(400, large)
    rows = [(i * 3 % 1009, simhash.signed(f)) for i, f in enumerate(fps)] + [(None, 5), (2000, simhash.signed(fps[9]))]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    root = brute_components({f % 2**64 for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            r = root[f % 2**64]
            least[r] = min(least.get(r, i), i)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least.get(root[f % 2**64])) for i, f in rows)


def test_query_rows(docs):
    rows = [(4, "Same words here now"), (2, "same WORDS here\nnow"), (7, None), (5, " \t"), (1, "other text of a kind"), (1, "other text of a kind"), (None, "lonely words stay alone")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(simhash.fingerprints(docs(rows))).collect()}
    assert got == {(4, 2), (2, 2), (7, 5), (5, 5), (1, 1), (None, None)}
    assert simhash.groups(simhash.fingerprints(docs([]))).count() == 0


def test_masks_cover_every_pair():
    levels = simhash.masks()
    assert [len(x) for x in levels] == [6, 36, 216] and [bin(x[0]).count("1") for x in levels] == [32, 48, 56]
    for i in range(64):
        for j in range(i):
            assert any(not m & (1 << i | 1 << j) for m in levels[0])


def test_radius_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(120)], [(5, i) for i in range(-50, 60)], [(3, 3)], [(7, 2), (2, 7), (9, 7), (-4, -9)]])
@pytest.mark.parametrize("alone", [0, graph.ALONE])
def test_components(spark, edges, alone):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = [tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), alone).collect()]
    assert sorted(got) == sorted(root.items())


def near_texts(seed=0, groups=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(groups):
        base = rng.choice(vocabulary, 200).tolist()
        texts.append(base)
        for _ in range(int(rng.integers(0, 5)) if g else 60):  # the first group is large
            copy = list(base)
            for at in rng.integers(0, 200, int(rng.integers(1, 4))):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(copy)
        texts.append(rng.choice(vocabulary, 200).tolist())
    return [" ".join(t) for t in texts]


def test_near_duplicates_against_brute_force(docs):
    texts = near_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "short one"), (903, "short one"), (904, "short two"), (None, texts[1])]
    known = docs(rows)
    sets = [set(near_dup.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = near_dup.drop_near_duplicates(known)
    assert kept.columns == known.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    keys = {}
    for i, (k, t) in enumerate(rows):
        keys.setdefault(find(i), []).append((k is None, k or 0, t or ""))
    stay = {min(v)[2] for v in keys.values()}
    assert got == Counter(k for k, t in rows if (t or "") in stay)


def test_near_duplicates_of_nothing(docs):
    assert near_dup.drop_near_duplicates(docs([])).count() == 0
    assert near_dup.drop_near_duplicates(docs([(1, None), (2, "a b c")])).count() == 2


def test_large_buckets_and_clusters_keep_groups_together(monkeypatch, docs):
    monkeypatch.setattr(near_dup, "SPLIT", 16)
    monkeypatch.setattr(near_dup, "PART", 20)
    texts = near_texts(3, groups=2)
    rows = [(i, t) for i, t in enumerate(texts)]
    small = {r["doc_id"] for r in near_dup.drop_near_duplicates(docs(rows)).collect()}
    assert 0 in small and len(small) < 12


def test_plan():
    bits, tables = near_dup.plan(1 << 20)
    assert bits == 17 and 60 < tables < 150


def test_parts_of_a_large_bucket_all_meet(spark):
    rows = [(1, i, i if i % 2 else 0) for i in range(60)] + [(1, 200 + i, 7) for i in range(300)] + [(2, i, i) for i in range(100, 105)]
    keyed = spark.createDataFrame(rows, "key long, node long, root long")
    root, met = {n: r for _, n, r in rows}, set()
    for r in near_dup.parted(keyed, near_dup.large_buckets(keyed, 16, 1), False).groupBy("key").agg(F.collect_list("node").alias("nodes")).collect():
        assert len(r["nodes"]) < 60
        met |= {(a, b) for a in r["nodes"] for b in r["nodes"] if a < b and root[a] != root[b]}
    assert met == {(a, b) for k, a, r in rows for j, b, s in rows if k == j and a < b and r != s}
    once = near_dup.parted(keyed, near_dup.large_buckets(keyed, 16, 1), True)
    assert once.count() == len(rows)  # the first pass sends each row to one part


def test_all_pairs_of_a_bucket_within_reach(spark):
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.integers(0, 2, (1, 64 * near_dup.WORDS), dtype=np.uint8), 120, 0)
    bits ^= (rng.random(bits.shape) < 0.08).astype(np.uint8)
    fp = np.packbits(bits, axis=1, bitorder="little")
    short = fp.view("<u8")[:, : near_dup.SENT]
    node, size = np.arange(120), 50 + 20 * (np.arange(120) % 2)
    rows = near_dup.Rows(node, node // 2 % 25, size, np.ascontiguousarray(short))
    for wide in (64, 200):  # by blocks, and row by row
        met = [(min(p), max(p)) for a, b in near_dup.all_pairs(node * 0, rows, wide) for p in zip(a.tolist(), b.tolist(), strict=True)]
        r = rows.root
        want = [(min(r[a], r[b]), max(r[a], r[b])) for a in range(120) for b in range(a + 1, 120) if r[a] != r[b] and size[a] == size[b] and near_dup.apart(short[a], short[b]) <= near_dup.REACH]
        assert sorted(met) == sorted(want) and 1000 < len(want) < 7000
    nodes = spark.createDataFrame([(i, i, 50, bytearray(x.tobytes())) for i, x in enumerate(fp)], "node long, root long, size long, fp binary")
    for split in (None, 16):  # a forest, and one for each part
        edges = near_dup.candidates(nodes, 120, split=split)
        assert graph.components(edges).select("root").distinct().count() == 1


def test_links_are_a_forest_of_all_that_reach_the_similarity():
    texts = near_texts(2, 6)
    sets = [near_dup.shingle_set(t) for t in texts]
    fp = np.stack([near_dup.wide_fingerprint(t)[1] for t in texts])
    words = [set(x.tolist()) for x in sets]
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        all_links = [(i, j) for i in range(len(sets)) for j in range(i) if (side[i] != side[j] or not side.any()) and len(words[i] & words[j]) >= 0.8 * len(words[i] | words[j])]
        a, b = near_dup.links(fp, sets, side, 0.8)
        assert {frozenset(p) for p in zip(a, b, strict=True)} <= {frozenset(p) for p in all_links}
        parts = lambda e: sorted(zip(*(x.tolist() for x in graph.forest(*(np.array(y, np.int64) for y in zip(*e, strict=True)))), strict=True))
        assert parts(list(zip(a, b, strict=True))) == parts(all_links) and len(a) == len(parts(all_links))


def test_texts_of_one_hash_are_told_apart(monkeypatch, docs):
    """Where the first hash of two texts is equal, the second text stays."""
    monkeypatch.setattr(near_dup, "text_hash", lambda text: F.length(F.coalesce(text, F.lit(""))).cast("long"))
    rows = [(1, "one two three four five six"), (2, "ten two three four five sex"), (3, "one two three four five six seven")]
    assert {r["doc_id"] for r in near_dup.drop_near_duplicates(docs(rows)).collect()} == {1, 2, 3}


@pytest.mark.parametrize("n", [45_000, 226_000, 13_600_000])
def test_plan_holds_for_one_fingerprint(n):
    """Tables sample the same fingerprint: pairs whose bits happen to differ more must still meet."""
    bits, tables = near_dup.plan(n)
    width = 64 * near_dup.WORDS
    rng = np.random.default_rng(1)
    d = rng.binomial(width, np.arccos(2 * 0.8 / 1.8) / np.pi, 40_000)
    agree = np.prod([(width - d - i) / (width - i) for i in range(bits)], 0)
    assert ((1 - agree) ** tables).mean() < 0.001


def bucket_of_groups(seed, sizes, share):
    """Rows of one bucket: groups of fingerprints that differ from their group's centre in that share of the bits."""
    rng = np.random.default_rng(seed)
    bits = np.concatenate([np.repeat(rng.integers(0, 2, (1, 64 * near_dup.SENT), dtype=np.uint8), n, 0) for n in sizes])
    bits ^= (rng.random(bits.shape) < share).astype(np.uint8)
    fp = np.packbits(bits[rng.permutation(len(bits))], axis=1, bitorder="little").view("<u8")
    return rng, np.ascontiguousarray(fp)


@pytest.mark.parametrize("share", [0.02, 0.06, 0.1, 0.2])
@pytest.mark.parametrize("joined", [False, True])
def test_pivot_tables_lose_no_pair(share, joined):
    rng, fp = bucket_of_groups(int(share * 100), [70, 40, 9, *[1] * 120], share)
    n = len(fp)
    root, size = rng.integers(0, n // 2, n) if joined else np.arange(n), rng.choice([10, 50, 55, 70], n)
    rows = near_dup.Rows(np.arange(n), root, size, fp)
    i, j = np.triu_indices(n, 1)
    keep = (root[i] != root[j]) & rows.near(i, j)
    want = sorted((min(p), max(p)) for p in zip(root[i[keep]].tolist(), root[j[keep]].tolist(), strict=True))
    pairs = lambda whole: [p for a, b in near_dup.all_pairs(root * 0, rows, whole=whole) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted((min(p), max(p)) for p in pairs(True)) == want and len(want) > 20
    parts = lambda e: sorted(zip(*(x.tolist() for x in graph.forest(*(np.array(y, np.int64) for y in zip(*e, strict=True)))), strict=True))
    assert parts(pairs(False)) == parts(want)


def test_pivot_tables_discard_pairs(monkeypatch):
    """A group is settled by its pivots; by the triangle inequality other groups aren't compared with it."""
    _, fp = bucket_of_groups(1, [400, 400, 400, 400], 0.04)
    rows, taken, real = near_dup.Rows(np.arange(1600), np.arange(1600), np.full(1600, 50), fp), [], near_dup.grid
    monkeypatch.setattr(near_dup, "grid", lambda a, b: taken.append(len(a) * len(b)) or real(a, b))
    found = near_dup.woods(near_dup.all_pairs(rows.node * 0, rows, whole=False))
    assert len(found) == 1596 and found["b"].nunique() == 4
    assert sum(taken) < 1600 * 1599 / 2 / 8


def test_rows_of_the_largest_root_are_not_compared(monkeypatch):
    _, fp = bucket_of_groups(4, [1] * 2000, 0)
    rows, taken, real = near_dup.Rows(np.arange(2000), np.arange(2000).clip(1900), np.full(2000, 50), fp), [], near_dup.grid
    monkeypatch.setattr(near_dup, "grid", lambda a, b: taken.append(len(a) * len(b)) or real(a, b))
    assert not len(near_dup.woods(near_dup.all_pairs(rows.node * 0, rows, whole=False)))
    assert 99 * 1901 <= sum(taken) < 2000 * 1999 / 2 / 8


def test_grid():
    _, fp = bucket_of_groups(2, [3, 4], 0.1)
    assert np.array_equal(near_dup.grid(fp, fp[:5]), near_dup.apart(fp[:, None], fp[:5]))


@pytest.mark.parametrize("n", [45_000, 226_000, 13_600_000])
def test_short_keys_hold_the_recall_and_send_few_rows(n):
    bits, tables = near_dup.plan(n, bucket=near_dup.BUCKET, least=near_dup.LEAST_BITS)
    width = 64 * near_dup.WORDS
    differ = np.random.default_rng(1).random((20_000, width)) < np.arccos(2 * 0.8 / 1.8) / np.pi
    missed = np.ones(len(differ), bool)
    for chosen in near_dup.table_bits(bits, tables):
        missed &= differ[:, chosen].any(1)
    assert missed.mean() < 0.001 and tables < 60
    assert n / 2**bits <= near_dup.BUCKET
