"""Approximate nearest neighbours: an inverted multi-index.

Two quantisers of K centroids each, fitted on at most SAMPLE vectors, code the halves of a vector;
the pair of codes is its cell. A query walks the pairs of centroids from the best summed nearness
down, with a heap, until the cells hold a share of the index, and the entries of those cells are
reranked by the exact inner product. Cells are laid into blocks, cell beside cell; a cell that is
larger fills blocks of its own. A query goes only to the blocks that hold a cell of its walk, about
BLOCKS of them at any size; a task holds a chunk of the queries sent to a block and what they found,
and streams the block's entries past them. So queries and results grow as the queries, and vectors are
copied only once for each CHUNK of queries. Equal vectors are one entry that keeps their TOP + 1 smallest ids: as
all have one score, no other id can be among the TOP results.

The share is learned: PROBES vectors of the fitted sample are searched in the sample by brute force,
and the walk must reach RECALL of what they find. Vectors without structure need about half of the
index, clustered ones far less (README has figures). In the whole index the nearest lie nearer than
in a sample, so a share that serves the sample serves the index.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do null ids; rows that repeat an id and its vector count
once; ties go to the smaller id; a query has fewer results if there are fewer candidates; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, table

K, SAMPLE, ROUNDS = 64, 20_000, 10
RECALL, PROBES, TOP = 0.95, 512, 20
#: A block has one in BLOCKS of the vectors, but so many at least.
BLOCKS, BLOCK_LEAST = 8, 512
#: Queries for which a block is copied once, tasks at most (a task takes several blocks beyond), scores held at once.
CHUNK, TASKS, SCORES = 1 << 14, 1 << 14, 1 << 21
#: Queries that one task walks.
WALKS = 128


def centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; a centroid without vectors stays where it is."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


class Codes:
    """The two quantisers, and where the cells lie."""

    def __init__(self, sample: np.ndarray, k: int = K):
        self.half = sample.shape[1] // 2
        self.c = (centroids(sample[:, : self.half], k), centroids(sample[:, self.half :], k))
        self.first = self.blocks = self.counts = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.c[0]) * len(self.c[1]) + nearest(x[:, self.half :], self.c[1])

    def lay(self, counts: np.ndarray, block: int) -> None:
        """From vectors of each cell: its first block and how many blocks it fills."""
        self.counts = counts
        self.first, self.blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        at = filled = 0
        for cell, n in enumerate(counts.tolist()):
            if filled and filled + n > block:
                at, filled = at + 1, 0
            self.first[cell] = at
            if n > block:
                self.blocks[cell] = -(-n // block)
                at += int(self.blocks[cell])
            else:
                filled += n

    def walk(self, q: np.ndarray, least: int) -> np.ndarray:
        """Cells in order of summed inner product with the centroids, until they hold `least` vectors."""
        s = (self.c[0] @ q[: self.half], self.c[1] @ q[self.half :])
        order = (np.argsort(-s[0], kind="stable").tolist(), np.argsort(-s[1], kind="stable").tolist())
        a, b = s[0][order[0]].tolist(), s[1][order[1]].tolist()
        wide, counts = len(b), self.counts
        heap, found, held = [(-a[0] - b[0], 0, 0)], [], 0
        while heap and held < least:
            _, i, j = heapq.heappop(heap)
            cell = order[0][i] * wide + order[1][j]
            if counts[cell]:
                found.append(cell)
                held += int(counts[cell])
            if j + 1 < wide:
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
        return np.array(found, np.int64)


def needed_share(codes: Codes, x: np.ndarray, top: int, recall: float, probes: int = PROBES) -> float:
    """Share of x that walks from evenly drawn rows of x must hold to meet `recall` of the rows' `top` nearest in x."""
    cell = codes.cells(x)
    counts = np.bincount(cell, minlength=len(codes.c[0]) * len(codes.c[1]))
    before = []
    for i in np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(top, len(x) - 1)]
        order = np.argsort(-np.add.outer(codes.c[0] @ x[i][: codes.half], codes.c[1] @ x[i][codes.half :]).ravel(), kind="stable")
        held = np.empty(len(order), np.int64)
        held[order] = np.cumsum(counts[order]) - counts[order]
        before.append(held[cell[near]])
    met = np.sort(np.concatenate(before))
    return (met[min(len(met) - 1, int(recall * len(met)))] + 1) / len(x) if len(met) else 1.0


def entries(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (digest of the vector), x (its bytes, float64) of the rows that take part."""
    sizes = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dim = sizes["d"] if sizes else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([v for v in pdf["v"]], np.float64).reshape(-1, dim) + 0.0  # -0 is 0
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            raw = [r.tobytes() for r in x[ok]]
            yield pd.DataFrame({"id": pdf["id"][ok], "key": [hashlib.blake2b(r, digest_size=16).hexdigest() for r in raw], "x": raw})

    v = F.col(vec_col)
    fit = (F.size(v) == dim) & (F.size(v) > 0) & ~F.exists(v, lambda y: y.isNull())
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & fit).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInPandas(run, "id long, key string, x binary")


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


class Nearest:
    """Queries (key, x, cells) and the `top` best entries of their cells so far, ties to the smaller first id."""

    def __init__(self, asked: pd.DataFrame, top: int):
        self.keys, self.y, self.top = asked["key"].to_numpy(), matrix(asked["x"]), top
        walked = [np.frombuffer(c, "<i4") for c in asked["cells"]]
        self.cells, at = np.unique(np.concatenate(walked), return_inverse=True)
        self.probed = np.zeros((len(asked), len(self.cells)), bool)
        self.probed[np.repeat(np.arange(len(asked)), [len(w) for w in walked]), at] = True
        self.least = np.full(len(asked), -np.inf)  # a query's worst kept score, once it has `top`
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))  # query, score, first id, ids

    def meet(self, entries: pd.DataFrame) -> None:
        at = np.searchsorted(self.cells, entries["cell"]).clip(max=len(self.cells) - 1)
        known = self.cells[at] == entries["cell"].to_numpy()
        at, entries = at[known], entries[known]
        if not len(at):
            return
        x, ids = matrix(entries["x"]), entries["ids"].to_numpy()
        first = np.array([i[0] for i in ids], np.int64)
        wanted = np.flatnonzero(self.probed[:, np.unique(at)].any(1))
        parts, step = [self.found], max(1, SCORES // len(at))
        for lo in range(0, len(wanted), step):
            rows = wanted[lo : lo + step]
            s = np.where(self.probed[np.ix_(rows, at)], self.y[rows] @ x.T, -np.inf)
            least = self.least[rows]
            if len(at) > self.top:
                least = np.maximum(least, np.partition(s, len(at) - self.top, axis=1)[:, len(at) - self.top])
            i, j = np.nonzero((s >= (least - 1e-9 * np.abs(least))[:, None]) & (s > -np.inf))
            parts.append((rows[i], (x[j] * self.y[rows[i]]).sum(1), first[j], ids[j]))
        query, score, first, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((first, -score, query))
        starts = np.searchsorted(query[order], query[order])
        place = np.arange(len(order)) - starts
        last = order[place == self.top - 1]
        self.least[query[last]] = score[last]
        order = order[place < self.top]
        self.found = (query[order], score[order], first[order], ids[order])

    def results(self) -> pd.DataFrame:
        return pd.DataFrame({"key": self.keys[self.found[0]], "score": self.found[1], "ids": self.found[3]})


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, recall: float = RECALL, share: float | None = None, least: int = 0, k: int = K, block: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` (a condition on the column id) the
    `top` others with the largest inner products found. A given share is taken in place of the learned one."""
    spark = rows.sparkSession
    all_rows = cut(entries(rows, id_col, vec_col), "vectors")
    order = Window.partitionBy("key").orderBy("id")
    few = all_rows.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)  # cut down in each task before it's dealt
    index = cut(few.groupBy("key").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    total = index.count()
    asked = cut(all_rows.where(is_query).select("id", "key", "x").dropDuplicates(["key", "id"]), "asked")
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    part = F.shiftrightunsigned(F.xxhash64("key", F.lit("fit")), 33) / float(2**31)
    sample = index.where(part < min(1.0, SAMPLE / total)).select("key", "x").toPandas()
    if sample.empty:
        sample = index.select("key", "x").orderBy("key").limit(1).toPandas()
    fitted = matrix(sample.sort_values("key")["x"])
    codes = Codes(fitted, k)
    share = needed_share(codes, fitted, top, recall) if share is None else share
    n_cells = len(codes.c[0]) * len(codes.c[1])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["cell"] = codes.cells(matrix(pdf["x"]))
                yield pdf

    coded = cut(index.mapInPandas(code, "key string, x binary, ids array<long>, cell long"), "coded")
    counts = np.zeros(n_cells, np.int64)
    for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # k * k rows at most
        counts[r["cell"]] = r["n"]
    codes.lay(counts, block or max(BLOCK_LEAST, -(-total // BLOCKS)))
    want = max(least, top + 1, math.ceil(share * total))
    queries = asked.groupBy("key").agg(F.first("x").alias("x"))
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // chunk))
    shared = spark.sparkContext.broadcast(codes)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for pdf in batches:
            out = []
            for key, raw in zip(pdf["key"], pdf["x"], strict=True):
                cells = at.walk(np.frombuffer(raw, np.float64), want)
                cells = np.repeat(cells, at.blocks[cells])
                blocks = at.first[cells] + np.concatenate([np.arange(x) for x in at.blocks[cells[np.flatnonzero(np.diff(cells, prepend=-1))]]]) if len(cells) else cells
                by = np.argsort(blocks, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1):
                    if len(part):
                        out.append((int(blocks[part[0]]) * chunks + int(key[:8], 16) % chunks, key, raw, cells[part].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["task", "key", "x", "cells"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            salt = np.array([int(x[8:16], 16) for x in pdf["key"]], np.int64)
            pdf["block"] = at.first[cell] + salt % at.blocks[cell]
            yield pdf

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, asked, near = None, [], None
        for pdf in batches:
            for (at, entry), some in pdf.groupby(["task", "entry"], sort=False):  # as sorted: a task's queries, then its entries
                if at != task:
                    if near:
                        yield near.results()
                    task, asked, near = at, [], None
                if not entry:
                    asked.append(some)
                elif asked:
                    near = near or Nearest(pd.concat(asked), top + 1)
                    near.meet(some)
        if near:
            yield near.results()

    dealt = queries.select("key", "x").repartition(max(1, -(-n_queries // WALKS)), "key")
    routed = dealt.mapInPandas(route, "task long, key string, x binary, cells binary")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    placed = coded.mapInPandas(place, "key string, x binary, ids array<long>, cell long, block long").withColumn("chunk", copies)
    here = placed.select((F.col("block") * chunks + F.col("chunk")).alias("task"), F.lit(True).alias("entry"), "key", "x", "cell", F.lit(b"").alias("cells"), "ids")
    there = routed.select("task", F.lit(False).alias("entry"), "key", "x", F.lit(0).cast("long").alias("cell"), "cells", F.array().cast("array<long>").alias("ids"))
    tasks = min(TASKS, chunks * int((codes.first + codes.blocks).max()))
    met = here.unionByName(there).repartitionById(tasks, (F.col("task") % tasks).cast("int")).sortWithinPartitions("task", "entry", "cell")
    found = met.mapInPandas(rerank, "key string, score double, ids array<long>")
    flat = found.select("key", "score", F.explode("ids").alias("vec_id"))
    near = cut(flat.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1), "near")
    own = asked.select(F.col("id").alias("query_id"), "key").join(near, "key").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("r"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
