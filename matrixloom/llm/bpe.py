"""Byte-level BPE encoding and decoding in numpy matrices.

The new words of a batch of texts (matches of the split pattern) are dealt by length into padded
matrices of token ids. In each round every row merges its leftmost pair of minimum rank, found in a
hash table of pairs; rows are closed up after a merge, and rows without a pair left are taken out.
Words over LONG bytes go through the same rule with a heap, a word at a time. Words met before come
from a bounded cache, so that a text costs its split and joins.

Defined results: a null text counts as empty and has no ids; a text is encoded whole, whatever its
length; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from matrixloom.llm.common import map_texts, small_batches, table
from matrixloom.llm.tokens import BYTE_LEVEL, PLAIN

#: Bytes of a word from which on the heap is used; words that a worker remembers at least (at most twice
#: as many and a batch's new ones); cells of one matrix.
LONG, CACHED, CELLS = 512, 300_000, 1 << 20
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> merged id: open addressing, one row of slots for each probe."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        self.probes = 0
        todo, slot, merged = np.arange(len(keys)), self.slot(keys), np.array(merged, np.int32)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            at, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[at >= 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[todo[first]], merged[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair has none or a side is negative."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return np.where((left < 0) | (right < 0), NONE, out).astype(np.int32)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.usual = pattern == public_tokenizers.PATTERN

    def split(self, text: str) -> list[str]:
        """The matches of the pattern. For plain texts Python's own engine finds the same ones faster."""
        return BYTE_LEVEL.findall(text) if self.usual and PLAIN.fullmatch(text) else self.pattern.findall(text)

    def merge_matrix(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of similar length, as ids."""
        width = max(map(len, words))
        n = np.array([len(w) for w in words])
        ids = np.full((len(words), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < n[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width)
        out: list[tuple[int, ...]] = [()] * len(words)
        live = np.arange(len(words))
        while True:
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[live[i]] = tuple(ids[i, : n[i]].tolist())
                keep = ~done
                live, ids, rank, n, at, best = live[keep], ids[keep], rank[keep], n[keep], at[keep], best[keep]
                if not len(live):
                    return out
                width = int(n.max())
                ids, rank = ids[:, : width + 1], rank[:, :width]
            row = np.arange(len(live))
            ids[row, at] = best
            column = np.arange(ids.shape[1])
            source = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, 1)
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], rank.shape[1] - 1), 1)
            n = n - 1
            ids[row, n] = -1
            rank[row, n - 1] = NONE
            rank[row, at] = self.pairs.get(best, ids[row, at + 1])
            back = np.flatnonzero(at > 0)
            rank[back, at[back] - 1] = self.pairs.get(ids[back, at[back] - 1], best[back])

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """One word by the same rule, with a heap of pairs over a linked list."""
        ids = [int(self.single[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        words, ranks = self.words, self.ranks
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(words[ids[i]] + words[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return tuple(x for x in ids if x >= 0)

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of words into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[word] = (whole,)
            elif len(raw) > LONG:
                self.cache[word] = self.merge_long(raw)
            else:
                groups.setdefault((len(raw) - 1).bit_length() if len(raw) > 16 else len(raw) + 100, []).append((word, raw))
        for group in groups.values():
            step = max(1, CELLS // max(len(raw) for _, raw in group))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (word, _), ids in zip(part, self.merge_matrix([raw for _, raw in part]), strict=True):
                    self.cache[word] = ids

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            rows, size, words = [], 0, set()
            while at < len(texts) and size < CELLS:
                size += len(texts[at] or "")
                rows.append(self.split(texts[at] or ""))
                words.update(rows[-1])
                at += 1
            if len(self.cache) > CACHED:
                self.old, self.cache = self.cache, {}
            new = words - self.cache.keys()
            known = new & self.old.keys()
            self.cache.update((w, self.old[w]) for w in known)
            self.learn(new - known)
            get = self.cache.__getitem__
            for row in rows:
                yield list(chain.from_iterable(map(get, row)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_open: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each worker process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _open[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary, from the ids) of every row."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def both(texts: list[str | None]) -> dict[str, list]:
        bpe = tokenizer(path, pattern)
        ids = list(bpe.encode_batch(texts))
        return {"ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    return map_texts(docs, lambda: both, "ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode(), but only digests leave the worker."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        bpe = tokenizer(path, pattern)
        digits = [str(i).encode() for i in range(len(bpe.words))]

        def run(texts: list[str | None]) -> dict[str, list]:
            n, a, b = [], [], []
            for ids in bpe.encode_batch(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(b" ".join(map(digits.__getitem__, ids))).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return run

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
