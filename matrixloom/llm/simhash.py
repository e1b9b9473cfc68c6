"""SimHash near-dedup with pivot distance tables.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Fingerprints at
RADIUS or fewer differing bits agree in two of four 16-bit blocks, so six keys, each of two blocks,
bring every such pair together in a bucket. In a bucket each fingerprint has a row of Hamming
distances to PIVOTS reference fingerprints; by the triangle inequality a pair whose rows differ by
more than RADIUS in any coordinate is discarded, and what survives is verified by the differing bits.
A bucket over LARGE fingerprints is keyed anew by two of four blocks of the bits left (twice at
most: then 56 bits are fixed, and a bucket has 256 fingerprints at most). That is exact. Equal
fingerprints are one node, whatever their number; a task passes on a star for each component of its
links, and components() joins the stars.

Defined results: a null text counts as empty; texts without a word have fingerprint zero and are
linked as any other; a null doc_id is larger than any other as a component's smallest; repeated rows
are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, lookup, map_texts, small_batches, table
from matrixloom.llm.graph import components, forest

SEED, WIDTH, RADIUS = 42, 3, 2
PIVOTS = 24
LARGE = 2048
#: Bytes of a text that are split into words at once, so that a very long one needs no more memory.
STEP = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
FULL = (1 << 64) - 1


def shingle_hashes(text: str | None, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included; words of about STEP bytes are held at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    kept: list[bytes] = []
    at, made = 0, False
    while at < len(data):
        blank = BLANK.search(data, min(at + STEP, len(data)))
        end = blank.start() if blank else len(data)
        words = kept + data[at:end].split()  # bytes: at [\x20\x09-\x0D] only
        at, n = end, len(words) - width + 1
        kept = words[max(0, n) :]
        if n > 0:
            made = True
            yield hashes(words, n, width)
    if kept and not made:
        yield hashes(kept, 1, len(kept))


def hashes(words: list[bytes], n: int, width: int) -> np.ndarray:
    """Of the n runs of `width` words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[i:j] for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)], repeat(SEED)), np.uint64, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of hashes[n, words] have each bit."""
    wide = hashes.reshape(len(hashes), -1).view(np.uint8)
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return counts + bits[whole:].sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        counts += bit_counts(h)
        n += len(h)
    return int(majority(counts, n)[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits) of every row."""

    def prints(texts: list[str | None]) -> dict[str, np.ndarray]:
        return {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, lambda: prints, "fp long")


def parts(bits: list[int]) -> list[int]:
    """The bits in four blocks, and the masks of each two of them."""
    step = len(bits) // 4
    blocks = [sum(1 << b for b in bits[i * step : (i + 1) * step]) for i in range(4)]
    return [x | y for x, y in combinations(blocks, 2)]


def masks() -> list[list[int]]:
    """By level: the bits that the buckets of each key share; six times as many keys on each level."""
    levels = [parts(list(range(64)))]
    for _ in range(2):
        levels.append([m | sub for m in levels[-1] for sub in parts([b for b in range(64) if not m >> b & 1])])
    return levels


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode()) for i in range(n)], np.uint64)


def bucket_links(key: np.ndarray, fp: np.ndarray, reference: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links in the buckets of one sorted stretch. key: sorted; fp: uint64."""
    n = len(key)
    last = np.searchsorted(key, key, side="right")  # each row's bucket ends before
    rows = np.flatnonzero(last - np.arange(n) > 1)
    near = np.bitwise_count(fp[:, None] ^ reference).astype(np.int8)  # the pivot distance table
    a, b, step = [], [], 1
    while len(rows):
        i, j = rows, rows + step
        for p in range(len(reference)):
            keep = np.abs(near[i, p] - near[j, p]) <= radius
            i, j = i[keep], j[keep]
            if not len(i):
                break
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        a.append(fp[i[keep]])
        b.append(fp[j[keep]])
        step += 1
        rows = rows[last[rows] > rows + step]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def stretches(batches: Iterator[pd.DataFrame], column: str = "key") -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut anew where the key changes."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        at = int(np.searchsorted(pdf[column].to_numpy(), pdf[column].iloc[-1]))
        if at:
            yield pd.concat([*kept, pdf.iloc[:at]]) if kept else pdf.iloc[:at]
            kept = []
        kept.append(pdf.iloc[at:])
    if kept:
        yield pd.concat(kept)


def links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """nodes: fp, each once. Returns a, b: stars with the same components as all links have."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    reference = pivots()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stretches(batches):
            a, b = bucket_links(pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64), reference, radius)
            yield pd.DataFrame({"a": a, "b": b})

    found = None
    rows = nodes.select("fp", F.lit(0).alias("path"))
    for level, level_masks in enumerate(masks()):
        own = F.array(*[F.lit(signed(m)) for m in level_masks])
        sub = F.explode(F.transform(F.sequence(F.col("path") * 6, F.col("path") * 6 + 5), lambda p: F.struct(p.alias("path"), F.xxhash64(p, F.col("fp").bitwiseAND(F.element_at(own, p + 1))).alias("key"))))
        keyed = cut(rows.select("fp", sub.alias("s")).select("fp", "s.path", "s.key"), "keys")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        big = cut(sizes.where(F.col("n") > large).select("key", F.lit(True).alias("_big")), "big") if level < 2 else None
        some = big is not None and not big.isEmpty()
        marked = keyed.join(big, "key", "left") if some else keyed.withColumn("_big", F.lit(None).cast("boolean"))
        few = marked.where("_big is null").select("key", "fp").repartition("key").sortWithinPartitions("key")
        stars = few.mapInPandas(run, "a long, b long")
        found = stars if found is None else found.unionByName(stars)
        if not some:
            break
        rows = marked.where("_big").select("fp", "path")
    return found


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: doc_id, fp. Returns doc_id, fp, component_id of every row."""
    prints = cut(prints, "prints")
    total = prints.count()
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    labelled = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "labelled")
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    known = cut(lookup(labelled, ids, "root", "fps", total).select("fp", "n", "component_id"), "known")
    return lookup(prints, known, "fp", "n", total).select("doc_id", "fp", "component_id")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = groups(fingerprints(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
