"""Near-duplicate texts by SimHash with pivot distance tables: five-word shingles, Jaccard similarity of 0.8 or more.

At that similarity about one fingerprint bit in seven differs, far beyond what blocks of a 64-bit
fingerprint can promise. So a text gets 1024 bits (sixteen hashes of each shingle), and as many tables
of sampled bits that a pair at the similarity asked for becomes a candidate with probability RECALL:
all tables sample one fingerprint, so their number follows from how many of its bits may differ. Rows
of a bucket within REACH differing bits of the first SENT words are candidates, and every candidate pair is verified by the
exact Jaccard similarity of the two whole texts' shingle sets. Every table sends a row once more, and
comparing costs little, so keys are short: BUCKET texts or fewer share one by chance, LEAST_BITS bits at least.

What is near in a bucket of over WIDE rows is told from pivot distance tables. Pivots are rows of the bucket itself, PIVOTS or
more at a time (drawn at random they would discard nothing: all rows lie half the bits away from them), and
the table has the Hamming distances of all rows left to them. That settles the pivots' own pairs. A row near a pivot
and within BALL of it belongs to its ball. By the triangle inequality rows farther from the pivot than
the ball's radius and REACH together are near none of the ball, and aren't compared with it; nor are rows that
the table has joined to the pivot, as they are in one component. Pivots and balls are done then; the rows left
get the next pivots, until none is left. That is exact. In smaller buckets every row is a pivot.

Only who is in a group with whom is asked for, so no pairs are passed on. A task that holds buckets
finds all near pairs in them and passes on a forest with the same components. The first pass takes
FIRST of the tables; the second takes all, and looks only at pairs that the first has not joined, so no
pair within REACH that shares a bucket is left out. Buckets over SPLIT rows are dealt in parts: rows of
the component that has most of the bucket, which need not meet one another, once for each part of the
others, and those for each part of it and of one another. What is joined so far is a cluster of
texts that may be near copies. Its shingle sets are sent to tasks, PART texts against PART texts, where all
pairs within WIDE_REACH of the whole fingerprints are verified, nearest first, but those that verified
links have joined already; what is passed on is again a forest.

Defined results: a null text counts as empty; equal texts are one node (of two texts with one 64-bit
hash, told apart by another, the second has no part in the search and stays); texts of fewer words than
five have one shingle, texts of none are equal to one another only; the row with the smallest doc_id
of a group stays (nulls last); repeated rows stay or go together; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, lookup, map_texts
from matrixloom.llm.graph import components, forest
from matrixloom.llm.simhash import STEP, bit_counts, majority, shingle_hashes, stretches

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.999
WORDS = 16
#: Words of a fingerprint that go with each key, and differing bits there of candidates, then of all words: a pair
#: at the similarity asked for has 0.15 of them with a deviation of 5.7 and 11.4 bits, two texts with nothing in common
#: half. Texts of less than SHORT shingles differ in more (measured: 0.19 for four shared of five).
SENT, REACH, WIDE_REACH, FEW = 4, 62, 205, 1.02
SHORT, SHORT_REACH, SHORT_WIDE_REACH = 16, 86, 260
#: Texts that share a key by chance, at most, and bits of a key, at least.
BUCKET, LEAST_BITS = 4096, 8
#: Tables of the first pass; rows over which a bucket is dealt in parts, one row in COUNTED of which is counted.
FIRST, SPLIT, COUNTED = 4, 8192, 16
#: Rows of a bucket up to which those of many buckets are compared at once; comparisons and pairs held; comparisons at once.
WIDE, HELD, GRID = 32, 1 << 20, 1 << 16
#: Pivots of a table at least, and the most that a ball's radius is.
PIVOTS, BALL = 24, 31
#: Texts of a cluster, and bytes of their shingle sets, that are verified against as many.
PART, PART_BYTES = 512, 1 << 24
#: Nodes up to which the table of candidates is broadcast, 8 bytes each.
BROADCAST_NODES = 500_000


def widen(h: np.ndarray) -> np.ndarray:
    """WORDS hashes of each hash."""
    out = np.empty((len(h), WORDS), np.uint64)
    out[:, 0] = h
    for i in range(1, WORDS):
        x = h + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def wide_fingerprint(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Shingles, and the fingerprint over their set: repeats would move it away from what Jaccard similarity sees."""
    counts, own = np.zeros(64 * WORDS, np.int64), shingle_set(text, width)
    step = STEP // WORDS
    for at in range(0, len(own), step):
        counts += bit_counts(widen(own[at : at + step]))
    return len(own), majority(counts, len(own))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def differing(bits: int, share: float) -> np.ndarray:
    """Chance of 0, 1, ... differing bits of so many, each of which differs with chance `share`."""
    d = np.arange(bits + 1)
    choose = np.concatenate(([0.0], np.cumsum(np.log((bits - d[:-1]) / (d[:-1] + 1)))))
    return np.exp(choose + d * math.log(share) + (bits - d) * math.log(1 - share))


def met(bits: int, tables: int, similarity: float = SIMILARITY) -> float:
    """Chance that a pair at the similarity shares a key in one table at least."""
    width, share = 64 * WORDS, apart_share(similarity)
    agree = np.prod([(width - np.arange(width + 1) - i).clip(0) / (width - i) for i in range(bits)], 0)
    return 1 - float(differing(width, share) @ (1 - agree) ** tables)


def apart_share(similarity: float) -> float:
    """Chance that a bit differs. Cosine of two sets of like size is 2J/(1+J); sets of few hundred
    shingles differ in FEW times as many bits as the angle says (measured: 0.150 for 0.147 at 0.8)."""
    return FEW * math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = 8, least: int = 14) -> tuple[int, int]:
    """Bits of a key (`least` or more) and number of tables for n texts, of which `bucket` or fewer share a key by
    chance, with room for the pairs beyond REACH."""
    bits = max(least, math.ceil(math.log2(max(2, n))) - int(math.log2(bucket)))
    share = apart_share(similarity)
    wanted = recall + float(differing(64 * SENT, share)[REACH + 1 :].sum() + differing(64 * WORDS, share)[WIDE_REACH + 1 :].sum())
    if wanted >= 1:
        raise ValueError("REACH is too small for this similarity and recall")
    low, high = 0, 1
    while met(bits, high, similarity) < wanted:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if met(bits, mid, similarity) < wanted else (low, mid)
    return bits, high


def table_bits(bits: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.stack([rng.choice(64 * WORDS, bits, replace=False) for _ in range(tables)])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every fingerprint of a and every one of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += np.bitwise_count(x[:, None] ^ y)
    return out


class Rows:
    """Rows of buckets: node, root of what is joined already, size (shingles), fp (words sent along)."""

    def __init__(self, node: np.ndarray, root: np.ndarray, size: np.ndarray, fp: np.ndarray, similarity: float = SIMILARITY, short_reach: int = SHORT_REACH, reach: int = REACH):
        self.node, self.root, self.size, self.fp, self.similarity = node, root, size, fp, similarity
        self.reaches, self.reach = (short_reach, reach), np.where(size < SHORT, short_reach, reach)

    def __getitem__(self, by) -> Rows:
        return Rows(self.node[by], self.root[by], self.size[by], self.fp[by], self.similarity, *self.reaches)

    def near(self, i, j, d: np.ndarray | None = None) -> np.ndarray:
        """Whether rows i and j may be near copies: sets of sizes too far apart can't reach the similarity."""
        x, y = self.size[i], self.size[j]
        d = apart(self.fp[i], self.fp[j]) if d is None else d
        return (d <= np.maximum(self.reach[i], self.reach[j])) & (np.minimum(x, y) >= self.similarity * np.maximum(x, y))


def steps(rows: Rows, last: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The roots of all near pairs in the buckets of the rows `at`, which end before `last`: rows one apart, two apart, ..."""
    at, step = at[last[at] > at + 1], 1
    while len(at):
        far = at[rows.root[at] != rows.root[at + step]]
        close = far[rows.near(far, far + step)]
        yield rows.root[close], rows.root[close + step]
        step += 1
        at = at[last[at] > at + step]


def all_pairs(key: np.ndarray, rows: Rows, wide: int = WIDE, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The roots of all near pairs of a stretch of buckets, where they differ, some at a time; where not `whole`, of
    enough of them for the same components."""
    by = np.lexsort((rows.root, key))
    key, rows = key[by], rows[by]
    first, last = np.searchsorted(key, key, side="left"), np.searchsorted(key, key, side="right")
    small = last - first <= wide
    yield from steps(rows, last, np.flatnonzero(small))
    for at in np.unique(first[~small]):
        own = rows[at : last[at]]
        for x, y in by_pivots(own, whole):
            yield own.root[x], own.root[y]


def by_pivots(rows: Rows, whole: bool = True, pivots: int = PIVOTS, ball: int = BALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of different roots in one bucket, whose rows are sorted by root: large groups get more pivots. Rows of
    the largest root, which need not meet one another, are no pivots."""
    left = np.arange(len(rows.node))
    roots, counts = np.unique(rows.root, return_counts=True)
    largest = rows.root == roots[counts.argmax()]
    while len(few := np.flatnonzero(~largest[left])):
        n = len(left)
        chosen = few[np.unique(np.linspace(0, len(few) - 1, max(pivots, min(n // 8, GRID // n))).astype(np.int64))]
        table = grid(rows.fp[left[chosen]], rows.fp[left])
        rest = np.ones(n, bool)
        rest[chosen] = False
        p, x = np.nonzero(table <= rows.reach[left].max())
        keep = (chosen[p] != x) & rows.near(left[chosen[p]], left[x], table[p, x])
        p, x = p[keep], x[keep]
        a, b = left[chosen[p]], left[x]
        keep = (rest[x] | (chosen[p] < x)) & (rows.root[a] != rows.root[b])
        yield a[keep], b[keep]
        inside = rest[x] & (table[p, x] <= ball)
        member, at = np.unique(x[inside], return_index=True)  # a row in several balls goes to the first
        owner = p[inside][at]
        for k in np.unique(owner).tolist():
            own, to = member[owner == k], table[k]
            rest[own] = False
            others = rest & (to <= to[own].max() + np.maximum(rows.reach[left[own]].max(), rows.reach[left]))
            if whole:
                yield from compared(rows, left[own])
            else:
                others[x[p == k]] = False
            yield from compared(rows, left[own], left[others])
        left = left[rest]


def compared(rows: Rows, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of different roots: of the rows at `left`, sorted by root, with those at `right`, else with one another."""
    if right is None:
        root = rows.root[left]
        right, beyond = left, np.searchsorted(root, root, side="right")  # the first of the next root
    else:
        beyond = np.zeros(len(left), np.int64)
    i, n = 0, len(left)
    while i < n and beyond[i] < len(right):
        after = int(beyond[i])
        j = min(n, i + max(1, GRID // (len(right) - after)))
        own, others = left[i:j], right[after:]
        d = grid(rows.fp[own], rows.fp[others])
        x, y = np.nonzero(d <= max(rows.reach[own].max(), rows.reach[others].max()))
        d, keep = d[x, y], y + after >= beyond[i + x]
        x, y = own[x], others[y]
        keep &= (rows.root[x] != rows.root[y]) & rows.near(x, y, d)
        yield x[keep], y[keep]
        i = j


def woods(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """A forest with the components of all pairs; at no time many more than HELD pairs are held."""
    a, b, n = [], [], 0
    for x, y in found:
        a.append(x)
        b.append(y)
        n += len(x)
        if n >= HELD:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, n = [x], [y], 0
    x, y = forest(np.concatenate(a), np.concatenate(b)) if n else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"a": x, "b": y})


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def second_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("second"))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """node (hash of the text), check (another), doc_id, size (shingles), fp (bytes) of every row."""

    def prints(texts: list[str | None]) -> dict[str, list]:
        made = [wide_fingerprint(t, width) for t in texts]
        return {"size": [n for n, _ in made], "fp": [fp.tobytes() for _, fp in made]}

    rows = docs.select(text_hash(F.col("text")).alias("node"), second_hash(F.col("text")).alias("check"), F.col("doc_id").cast("long"), F.col("text"))
    return map_texts(rows, lambda: prints, "size long, fp binary", ("node", "check", "doc_id"))


def parted(keyed: DataFrame, big: DataFrame, first: bool) -> DataFrame:
    """keyed: key, node, root and others. big: key, _root (the largest group in that bucket), _own and _parts (how many
    parts that group and the other rows get). Rows of a large bucket go to parts; but for the first pass, every two
    rows of different roots still meet in one of them."""
    if big.isEmpty():
        return keyed
    side = F.broadcast(big) if big.count() <= BROADCAST_NODES else big
    h = F.xxhash64("node", "key")
    own, part = F.pmod(h, F.col("_own")).cast("int"), F.pmod(h, F.col("_parts")).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    if first:
        keys = F.array(F.xxhash64("key", F.lit("first"), F.pmod(h, F.col("_own") + F.col("_parts"))))
    else:
        with_own = F.transform(numbers("_own"), lambda p: F.xxhash64("key", F.lit("own"), p, part))
        with_others = F.transform(numbers("_parts"), lambda q: F.xxhash64("key", F.lit("others"), F.least(part, q), F.greatest(part, q)))
        keys = F.when(F.col("root") == F.col("_root"), F.transform(numbers("_parts"), lambda q: F.xxhash64("key", F.lit("own"), own, q))).otherwise(F.concat(with_own, with_others))
    marked = keyed.join(side, "key", "left")
    return marked.withColumn("_key", F.explode(F.when(F.col("_root").isNull(), F.array("key")).otherwise(keys))).select(F.col("_key").alias("key"), *keyed.columns[1:])


def large_buckets(some: DataFrame, split: int, counted: int = COUNTED) -> DataFrame:
    """Of the keyed rows of one node in `counted`: the buckets over split rows, as parted() takes them. The sizes are
    estimates: they decide how large a task gets, not which rows meet."""
    per = some.groupBy("key", "root").agg((F.count(F.lit(1)) * counted).alias("n"))
    sizes = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where(F.col("n") > split)
    parts = lambda n: F.greatest(F.lit(1), F.ceil(2 * n / split)).cast("int")
    return cut(sizes.select("key", F.col("top.root").alias("_root"), parts(F.col("top.n")).alias("_own"), parts(F.col("n") - F.col("top.n")).alias("_parts")), "near_big")


def candidates(nodes: DataFrame, total: int, similarity: float = SIMILARITY, recall: float = RECALL, split: int | None = None, first: int = 0) -> DataFrame:
    """nodes: node, root (of what is joined already), size, fp, each once. Returns edges a, b between roots that have
    near pairs, with the same components as all such pairs have; with `first`, by so many tables."""
    bits, tables = plan(total, similarity, recall, BUCKET, LEAST_BITS)
    tables = min(first or tables, tables)
    chosen = table_bits(bits, tables)
    weight = 1 << np.arange(bits, dtype=np.int64)
    fields = ["key", "node", "root", "size", *[f"f{i}" for i in range(SENT)]]
    split = SPLIT if split is None else split

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(pdf), -1)
                ones = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                key = np.stack([ones[:, sel] @ weight | (t << 48) for t, sel in enumerate(chosen)], 1)
                fp = raw.view("<i8")
                yield pd.DataFrame({"key": key.ravel()} | {c: np.repeat(pdf[c].to_numpy(), tables) for c in fields[1:4]} | {f"f{i}": np.repeat(fp[:, i], tables) for i in range(SENT)})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stretches(batches):
            key, root, size = (pdf[c].to_numpy(np.int64) for c in ("key", "root", "size"))
            rows = Rows(root, root, size, np.ascontiguousarray(pdf[fields[4:]].to_numpy(np.int64)).view(np.uint64), similarity)
            yield woods(all_pairs(key, rows, whole=False))

    schema = ", ".join(f"{c} long" for c in fields)
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit("count")), F.lit(COUNTED)) == 0)
    rows = parted(nodes.mapInPandas(keys, schema), large_buckets(some.mapInPandas(keys, schema), split), bool(first))
    return rows.drop("node").repartition("key").sortWithinPartitions("key").mapInPandas(pairs, "a long, b long").distinct()


def links(fp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Positions of verified pairs that make a forest with the components of all pairs that reach the similarity. side: rows
    of 0 meet rows of 1; where there are none of 1, all rows meet. Nearest pairs come first."""
    n = len(sets)
    rows = Rows(np.arange(n), np.arange(n), np.array([len(x) for x in sets]), fp, similarity, SHORT_WIDE_REACH, WIDE_REACH)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n),) * 2
    found, block = [], max(1, HELD // max(1, len(right)))
    for at in range(0, len(left), block):
        own = left[at : at + block]
        d = grid(fp[own], fp[right])
        x, y = np.nonzero(rows.near(own[:, None], right[None], d) & (side.any() | (own[:, None] < right[None])))
        found.append(np.stack((d[x, y], own[x], right[y])))
    d, x, y = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    by = np.argsort(d, kind="stable")
    root, words, a, b = list(range(n)), {}, [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def words_of(i: int) -> set[int]:
        if i not in words:
            words[i] = set(sets[i].tolist())
        return words[i]

    for i, j in zip(x[by].tolist(), y[by].tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            both = len(words_of(i) & words_of(j))
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[q] = p
                a.append(i)
                b.append(j)
    return a, b


def verified(members: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """members: node, check, cluster, size, fp of texts in clusters of two or more. Returns a, b: a forest with the
    components of all pairs of a cluster whose whole texts reach the similarity."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("size") * 8 / PART_BYTES)).cast("int").alias("parts"))
    members = cut(lookup(members, sizes, "cluster", "n", members.count()), "near_members")
    named = members.select("node", "check")
    side = F.broadcast(named) if named.count() <= BROADCAST_NODES else named
    rows = docs.select(text_hash(F.col("text")).alias("node"), second_hash(F.col("text")).alias("check"), F.col("text"))

    def sets(texts: list[str | None]) -> dict[str, list]:
        return {"set": [shingle_set(t, width).tobytes() for t in texts]}

    some = rows.join(side, ["node", "check"], "left_semi")
    known = cut(map_texts(some.dropDuplicates(["node"]), lambda: sets, "set binary", ("node",)), "near_sets")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    pair = lambda q: F.struct(F.xxhash64("cluster", F.least(part, q), F.greatest(part, q)).alias("key"), (part > q).cast("int").alias("side"))
    dealt = members.join(known, "node").select("node", "fp", "set", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)).alias("to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stretches(batches):
            key = pdf["key"].to_numpy(np.int64)
            fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
            node, side, own = pdf["node"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in pdf["set"]]
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
            for at, end in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                a, b = links(fp[at:end], own[at:end], side[at:end], similarity)
                yield pd.DataFrame({"a": node[at:end][a], "b": node[at:end][b]})

    return dealt.select("to.key", "to.side", "node", "fp", "set").repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """node, check, keep_node of every node that goes: texts in one group with keep_node, which has the smallest doc_id."""
    prints = cut(fingerprints(docs, width), "near_prints")
    one = prints.groupBy("node").agg(F.min(F.struct("check", F.col("doc_id").isNull().alias("none"), "doc_id", "size", "fp")).alias("r"))
    nodes = cut(one.select("node", "r.check", F.col("r.doc_id").alias("first"), "r.size", "r.fp"), "near_once")
    total = nodes.count()
    alone = nodes.select("node", F.col("node").alias("root"), "size", "fp")
    joined = cut(components(cut(candidates(alone, total, similarity, recall, first=FIRST), "near_few")), "near_joined")
    grouped = cut(nodes.join(joined, "node", "left").select("node", "check", F.coalesce("root", "node").alias("root"), "size", "fp"), "near_grouped")
    more = cut(components(cut(candidates(grouped, total, similarity, recall), "near_more")), "near_clusters")
    # joined roots are few: every cluster's nodes by their root, then by what that root was joined to
    roots = cut(joined.select("node", "root").join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("cluster"))
        .unionByName(more.join(joined, "node", "left_anti").select("node", F.col("root").alias("cluster"))), "near_tops")
    members = cut(nodes.join(roots, "node").select("node", "check", "cluster", "size", "fp"), "near_clustered")
    found = components(cut(verified(members, docs, similarity, width), "near_links"))
    groups = cut(found.join(nodes.select("node", "check", "first"), "node"), "near_roots")
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("k"), F.count(F.lit(1)).alias("n")).select("root", "n", F.col("k.node").alias("keep_node"))
    return lookup(groups, keep, "root", "n", groups.count()).where("node != keep_node").select("node", "check", "keep_node")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """docs without the near copies; all columns stay."""
    gone = cut(near_duplicates(docs, similarity, width).select(F.col("node").alias("_node"), F.col("check").alias("_check")), "near_gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    marked = docs.withColumns({"_node": text_hash(F.col("text")), "_check": second_hash(F.col("text"))})
    return marked.join(side, ["_node", "_check"], "left_anti").select(*docs.columns)
