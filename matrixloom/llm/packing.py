"""Packing: sum-of-squares online packing into windows of a fixed size.

Each input partition packs its documents as they come. Whole windows are cut off a document first;
the rest goes to the fill level that makes the sum of squared counts of partially filled windows
least, read off one array of counts by level. Windows that are still open at a partition's end (or
when MAX_OPEN are) are passed on: their pieces are packed again, by the same rule, ROUND ids to a
task, until one task has all that is left. So how finely the input is split hardly matters. That last
task closes its open windows by the level array too: the fullest takes the fullest others that fit,
and a piece is cut only to fill what none fits in. The last rest is cut into powers of two, which
need no padding, so no window has any.

Defined results: a null text counts as empty and has the end id only; repeated rows are packed each;
levels that are equally good go to the fullest, a new window comes last, and windows of one level are
taken latest first; an empty table gives an empty result; other columns are ignored. Which documents
share a window depends on the input's partitions; sequence_id is unique but not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matrixloom.llm.common import cut, small_batches, table
from matrixloom.llm.tokens import WORD_END, encoder

WINDOW = 4096
#: Partially filled windows that a task holds at most; their ids take MAX_OPEN * WINDOW * 2 bytes.
MAX_OPEN = 2048
#: Ids of open windows that one task packs again.
ROUND = 1 << 25
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[object, int, int, np.ndarray]  # doc_id, start in the document, the document's ids, the piece's ids


class SumOfSquares:
    """Open windows by fill level, and how many there are of each."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level(self, size: int) -> int:
        """The level (0: a new window) where `size` more ids make the sum of squares least; ties go to the fullest."""
        c, w = self.count, self.window
        new = 2 * c[size] + 1
        if size == w or not self.n_open:
            return 0
        here = c[1 : w - size + 1]
        gain = 2 * (c[1 + size : w + 1] - here + 1)
        gain[-1] = 1 - 2 * here[-1]  # a full window no longer counts
        gain = np.where(here > 0, gain, np.int64(2**62))
        best = len(gain) - 1 - int(gain[::-1].argmin())
        return best + 1 if gain[best] <= new else 0

    def add(self, doc_id, start: int, n: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place ids of a document of n, from `start` on; yields the windows that they fill."""
        w = self.window
        whole = len(ids) - len(ids) % w
        for at in range(0, whole, w):
            yield [(doc_id, start + at, n, ids[at : at + w])]
        size = len(ids) - whole
        if not size:
            return
        h = self.level(size)
        window = self.take(h) if h else []
        window.append((doc_id, start + whole, n, ids[whole:].copy()))
        if h + size == w:
            yield window
        else:
            self.put(h + size, window)

    def take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def put(self, h: int, window: list[Piece]) -> None:
        self.open.setdefault(h, []).append(window)
        self.count[h] += 1
        self.n_open += 1

    def rest(self) -> list[Piece]:
        """The pieces of all open windows, which are open no more."""
        pieces = [p for h in sorted(self.open, reverse=True) for window in self.open[h] for p in window]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        return pieces

    def close(self) -> Iterator[list[Piece]]:
        """All open windows as full ones, by their levels; then powers of two."""
        left = int(self.count @ np.arange(self.window + 1))
        while left >= self.window:
            at = int(np.flatnonzero(self.count)[-1])
            full = self.take(at)
            while at < self.window:
                fits = np.flatnonzero(self.count[: self.window - at + 1])
                if len(fits):
                    full += self.take(int(fits[-1]))
                    at += int(fits[-1])
                else:  # cut what is missing off the least filled one
                    h = int(np.flatnonzero(self.count)[0])
                    source, room = self.take(h), self.window - at
                    self.put(h - room, cut_off(source, room, full))
                    at = self.window
            yield full
            left -= self.window
        pieces = self.rest()
        while left:
            size = 1 << (left.bit_length() - 1)
            out: list[Piece] = []
            pieces = cut_off(pieces, size, out)
            yield out
            left -= size


def cut_off(pieces: list[Piece], size: int, out: list[Piece]) -> list[Piece]:
    """Moves the first `size` ids of the pieces to `out`; returns what is left of them."""
    for i, (doc_id, start, n, ids) in enumerate(pieces):
        out.append((doc_id, start, n, ids[:size]))
        if len(ids) > size:
            return [(doc_id, start + size, n, ids[size:]), *pieces[i + 1 :]]
        size -= len(ids)
        if not size:
            return pieces[i + 1 :]
    return []


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, max_open: int = MAX_OPEN, round_ids: int = ROUND) -> DataFrame:
    """A row for each piece: SCHEMA. `ids` of the rows that are passed on are in no window yet."""
    full = StructType.fromDDL(f"{SCHEMA}, ids binary")
    kinds = to_arrow_schema(full)

    def packed(rows: Iterator[list[tuple]], sort: int, final: bool) -> Iterator[pa.RecordBatch]:
        """rows: batches of (doc_id, start, n, ids); sort: of the round, so that no two give the same sequence_id."""
        packer, number, out = SumOfSquares(window, max_open), (sort << 24 | TaskContext.get().partitionId()) << 32, []

        def put(windows: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in windows:
                at = 0
                for doc_id, start, n, ids in pieces:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, at, None))
                    at += len(ids)
                number += 1

        def pass_on() -> None:
            out.extend((doc_id, start, len(ids), None, n, None, None, ids.astype("<u4").tobytes()) for doc_id, start, n, ids in packer.rest())

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(columns, kinds, strict=True)], schema=kinds)

        for some in rows:
            for piece in some:
                put(packer.add(*piece))
                if packer.n_open >= max_open:
                    put(packer.close()) if final else pass_on()
            yield batch()
        put(packer.close()) if final else pass_on()
        yield batch()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, WORD_END)
        end = np.array([end_id], encode.kind)

        def rows() -> Iterator[Iterator[tuple]]:
            for b in batches:
                made = (np.concatenate((ids, end)) for ids in encode.encode_all(b.column(1).to_pylist()))
                yield ((key, 0, len(ids), ids) for key, ids in zip(b.column(0).to_pylist(), made, strict=True))

        return packed(rows(), 0, False)

    def again(sort: int, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[list[tuple]]:
                for b in batches:
                    doc_id, start, n, ids = (b.column(i).to_pylist() for i in range(4))
                    yield [(k, s, m, np.frombuffer(x, "<u4")) for k, s, m, x in zip(doc_id, start, n, ids, strict=True)]

            return packed(rows(), sort, final)

        return run

    done, tasks = [], 1 << 30
    step = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, full), "packed")
    while True:
        done.append(step.where("ids is null").drop("ids"))
        left = step.where("ids is not null")
        total = left.agg(F.sum("length")).first()[0]
        if not total:
            break
        tasks = min(-(-total // round_ids), max(1, tasks // 4))  # fewer each time
        step = cut(left.select("doc_id", "start", "doc_tokens", "ids").coalesce(tasks).mapInArrow(again(len(done), tasks == 1), full), "packed")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
