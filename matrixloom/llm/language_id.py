"""Language ID: script ranges narrow the candidates of each word, then Viterbi over per-word
scores with a switching penalty labels spans of mixed-language text.

A word is a run of letters and marks. Its score for a language is the log probability of its
boundary-padded character trigrams (hashed to 2**BITS counts for each language). A language is a
candidate for words of a script only if it wrote at least SCRIPT_SHARE of its letters in that
script. Switching between words costs SWITCH; a document's label is the language with most letters
on the best path. Counts are learned in Spark from labelled rows; only the table of counts
(2**BITS x languages) reaches the driver. TRAIN_ROWS bounds the labelled rows that are fitted on.

Defined results: a text that is null or has no letter is `und` with score 0; with no labelled row
to learn from, every text is `und`; ties go to the language that sorts first; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm.common import filter_texts, held_out, map_texts, small_batches, table

BITS = 17
#: At most about so many labelled rows are fitted on, taken by a hash of doc_id; each language has at least
#: LANG_ROWS of them, or all that it has.
TRAIN_ROWS, LANG_ROWS = 20_000, 500
#: Nats that a switch of language between two words costs.
SWITCH = 12.0
SCRIPT_SHARE = 0.001
#: Added to every count.
SMOOTH = 0.1
#: What a word scores for a language that does not write its script.
OUTSIDE = -60.0
#: Characters, and words on one Viterbi sequence, that are worked on at once.
CHUNK, SEQUENCE = 1 << 19, 1 << 19
#: First and last code point of scripts. Letters outside share the number 0.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02FF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for _, _, s in SCRIPTS))


@cache
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 letter, 2 mark, 0 neither; and the number of its script."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        kind[c] = 1 if k == "L" else 2 if k == "M" else 0
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for a, b, name in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return kind, script


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_grams(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lower-case code points: hashed trigrams word after word; where each word's begin; its
    letters; its script; where it starts. A word of n characters has n + 1 trigrams."""
    kind, script = char_tables()
    k = kind[codes]
    inside = k > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate(([0], np.cumsum(k == 1)))
    n_letters = letters[ends] - letters[starts]
    keep = n_letters > 0
    starts, ends, n_letters = starts[keep], ends[keep], n_letters[keep]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sizes = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # position of each gram's last character; the last gram of a word ends in a boundary
    where = np.arange(sizes.sum()) - np.repeat(at - starts, sizes)
    step = where - np.repeat(starts, sizes)
    last = np.repeat(ends, sizes)
    padded = np.concatenate((codes.astype(np.uint32), np.zeros(1, np.uint32)))
    c = np.where(where < last, padded[where], np.uint32(0))
    b = np.where(step >= 1, padded[where - 1], np.uint32(1))
    a = np.where(step >= 2, padded[where - 2], np.uint32(1))
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    return h.astype(np.int64), at, n_letters, script[codes[starts]].astype(np.int64), starts


def pieces(text: str, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """The text in pieces of about `size` that end after a non-word character; a longer word stays whole."""
    word = lambda i: text[i].isalpha() or unicodedata.category(text[i])[0] == "M"
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            back = end
            while back > at and word(back - 1):
                back -= 1
            if back > at:
                end = back
            else:  # a run of letters longer than a piece is a piece of its own
                while end < len(text) and word(end):
                    end += 1
        yield at, text[at:end]
        at = end


class Model:
    """langs (sorted), scores[2**BITS, L], allowed[scripts, L]."""

    def __init__(self, langs: list[str], scores: np.ndarray, allowed: np.ndarray, switch: float = SWITCH):
        self.langs, self.scores, self.allowed, self.switch = langs, scores, allowed, switch

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """scores[words, L], letters[words], first character[words] of one whole text."""
        got = []
        for at, piece in pieces(text):
            h, first, letters, script, starts = word_grams(codes_of(lower(piece)))
            if len(first):
                s = np.add.reduceat(self.scores[h], first, axis=0)
                may = self.allowed[script]
                got.append((np.where(may, s, np.where(may.any(1, keepdims=True), s.min(1, keepdims=True) + OUTSIDE, 0.0)).astype(np.float32), letters, starts + at))
        if not got:
            none = np.zeros(0, np.int64)
            return np.zeros((0, len(self.langs)), np.float32), none, none
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first character, end, language) of each span; the spans cover from the first word to the end of the text."""
        s, _, starts = self.word_scores(text or "")
        if not len(s):
            return []
        path = viterbi(s, np.zeros(len(s), bool), self.switch)
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = [*starts[cuts[1:]], len(text)]
        return [(int(starts[i]), int(e), self.langs[path[i]]) for i, e in zip(cuts, ends, strict=True)]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (its share of the letters) of each text."""
        langs, shares = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, shares
        pending: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not pending:
                return
            s = np.concatenate([x[1] for x in pending])
            n = np.array([len(x[1]) for x in pending])
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            fresh = np.zeros(len(s), bool)
            fresh[at] = True
            path = viterbi(s, fresh, self.switch)
            doc = np.repeat(np.arange(len(pending)), n)
            letters = np.zeros((len(pending), len(self.langs)))
            np.add.at(letters, (doc, path), np.concatenate([x[2] for x in pending]))
            for (i, _, _), row in zip(pending, letters, strict=True):
                best = int(row.argmax())
                langs[i], shares[i] = self.langs[best], float(row[best] / row.sum())
            pending.clear()

        waiting = 0
        for i, text in enumerate(texts):
            s, letters, _ = self.word_scores(text or "")
            if len(s):
                pending.append((i, s, letters))
                waiting += len(s)
            if waiting >= SEQUENCE:
                flush()
                waiting = 0
        flush()
        return langs, shares


def lower(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def viterbi(scores: np.ndarray, fresh: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word. scores[n, L]; at a `fresh` word any language starts for
    nothing; elsewhere a change costs `switch`. The sequence is cut into about sqrt(n) blocks that
    advance in step: first each block's best sums from every entry to every exit, then the entries,
    then the paths."""
    n, L = scores.shape
    step = max(1, int(n**0.5))
    rows = -(-n // step)
    pad = rows * step - n
    s = np.concatenate((scores, np.zeros((pad, L), scores.dtype))).astype(np.float64).reshape(rows, step, L)
    f = np.concatenate((fresh, np.ones(pad, bool))).reshape(rows, step)
    f = f.copy()
    f[0, 0] = True
    inf = 1e18
    v = np.full((rows, L, L), -inf)  # [block, entry, language now]
    v[:, np.arange(L), np.arange(L)] = 0
    for t in range(step):
        best = v.max(2, keepdims=True)
        v = np.where(f[:, t, None, None], best, np.maximum(v, best - switch)) + s[:, t, None, :]
    entry = np.zeros((rows, L))
    for r in range(1, rows):
        entry[r] = (entry[r - 1][:, None] + v[r - 1]).max(0)
        entry[r] -= entry[r].max()
    v = entry
    back = np.empty((step, rows, L), np.int16)
    for t in range(step):
        arg = v.argmax(1)
        best = v[np.arange(rows), arg][:, None]
        jump = f[:, t, None] | (best - switch > v)
        back[t] = np.where(jump, arg[:, None], np.arange(L))
        v = np.where(jump, np.where(f[:, t, None], best, best - switch), v) + s[:, t]
    path = np.empty((rows, step), np.int16)
    # exits: from the last block to the first, one block's way back at a time for all exits at once
    ways = np.empty((step + 1, rows, L), np.int16)
    ways[step] = np.arange(L)
    for t in range(step - 1, -1, -1):
        ways[t] = np.take_along_axis(back[t], ways[t + 1].astype(np.int64), 1)
    exits = np.empty(rows, np.int64)
    now = int(v[rows - 1].argmax())
    for r in range(rows - 1, -1, -1):
        exits[r] = now
        now = int(ways[0, r, now])
    for t in range(step):
        path[:, t] = ways[t + 1][np.arange(rows), exits]
    return path.reshape(-1)[:n].astype(np.int64)


def count_grams(batches: Iterator[pd.DataFrame], langs: list[str]) -> Iterator[pd.DataFrame]:
    """Counts of a task: cell = (gram or 2**BITS + script) * L + language, n."""
    L, place = len(langs), {x: i for i, x in enumerate(langs)}
    counts = np.zeros((2**BITS + len(SCRIPT_NAMES)) * L)
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            for _, piece in pieces(text):
                h, first, letters, script, _ = word_grams(codes_of(lower(piece)))
                if len(first):
                    np.add.at(counts, h * L + place[lang], 1)
                    np.add.at(counts, (2**BITS + script) * L + place[lang], letters)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"cell": at, "n": counts[at].astype(np.int64)})


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of rows that aren't held out; about `rows` of them at most."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    L = len(langs)
    if not L:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0), bool))
    part = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), 33) / float(2**31)
    rates = {x: min(1.0, max(rows / total, LANG_ROWS / n)) for x, n in sizes.items()}
    rate = F.element_at(F.create_map(*[F.lit(v) for x in rates.items() for v in x]), F.col("lang"))
    sample = known.where(part < rate).where("text is not null").select("text", "lang")
    got = sample.mapInPandas(lambda x: count_grams(x, langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2**BITS + len(SCRIPT_NAMES)) * L)
    counts[got["cell"].to_numpy(np.int64)] = got["n"]
    counts = counts.reshape(-1, L)
    grams, scripts = counts[: 2**BITS], counts[2**BITS :]
    scores = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * 2**BITS)).astype(np.float32)
    return Model(langs, scores, scripts > SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: lambda texts: dict(zip(("lang_pred", "score"), shared.value.label(texts), strict=True)), "lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows with a language that has at least `least` of the letters, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: list[str | None]) -> list[bool]:
        return [lang != "und" and score >= least for lang, score in zip(*shared.value.label(texts), strict=True)]

    return filter_texts(docs, lambda: known)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
