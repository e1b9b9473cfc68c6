"""Connected components of an edge table, by alternating large and small stars.

No group of edges is collected, and none goes to one task: a star takes the least neighbour of each
node, which is combined in every task before the shuffle, and joins it back to the node's edges; what is
hot there is broadcast (see lookup()). Every round is written to the shared folder. Stars need few
rounds; a chain of n nodes needs about log n. Once ALONE edges or fewer are left, counted before, one
task joins them, which holds 16 bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, lookup


#: Edges that one task joins.
ALONE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges (a, b): its nodes and their least node, without the least itself."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            break
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each batch as stars."""
    for pdf in batches:
        a, b = forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": a, "b": b})


def with_least(edges: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """edges a, b with m: the least b of a in `groups` (a, b). A hot a is combined in each task, and its
    least is sent to its edges where they lie."""
    least = groups.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup(edges, least, "a", "n", total)


def large_star(star: DataFrame, total: int) -> DataFrame:
    """The larger neighbours of every node point to the least of it and its neighbours. Edges go from the larger node."""
    up = star.select(F.col("b").alias("a"), F.col("a").alias("b"))  # each node's larger neighbours
    return with_least(up, star.unionByName(up), 2 * total).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(star: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours point to the least of them. Edges go from the larger node."""
    known = with_least(star, star, total)
    return known.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(known.select("a", F.col("m").alias("b"))).distinct()


def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pdf in batches:
        a, b = np.concatenate((a, pdf["a"].to_numpy(np.int64))), np.concatenate((b, pdf["b"].to_numpy(np.int64)))
    a, b = forest(a, b)
    yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, alone: int = ALONE, most_rounds: int = 40) -> DataFrame:
    """edges: a, b (longs, never null). Returns node, root: every node with an edge, and the least node of its component."""
    away = edges.where("a != b").mapInPandas(contract, "a long, b long")
    star, before = cut(away.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"), None
    for _ in range(most_rounds):
        sign = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        few = sign[0] <= alone
        if few:
            star = cut(star.repartition(1).mapInPandas(finish, "a long, b long"), "stars")
        if few or sign == before:
            # a star now: each node once, with its root
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = sign
        large = cut(large_star(star, sign[0]), "stars")
        star = cut(small_star(large, large.count()), "stars")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
