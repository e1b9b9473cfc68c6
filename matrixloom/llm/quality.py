"""Quality classifier: Bradley-Terry pairwise ranking.

A document's merit is w . x of its features x. From preference pairs (a document marked good over
one marked bad) w is learned by the logistic loss on feature differences. The cut is a quantile of
the merits of the labelled rows: the share of bad rows among them. A score is a logistic function
of the merit, with the cut at 0.3. Features are counted over the whole text, whatever its language.
FIT_ROWS bounds the labelled rows, and PAIRS the pairs, that are fitted on.

Defined results: a null text counts as empty, and the empty text has a score as any other; without
both labels to learn from every score is 1; a label that is null or of no document is not used;
repeated rows of labels and of documents count once in the fit (ids that many texts share are thinned
by a hash of the text); a document at the cut itself is good; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm.common import filter_texts, held_out, map_texts, small_batches, table

#: At most about so many labelled rows, and so many pairs of them, are fitted on.
FIT_ROWS, PAIRS = 20_000, 200_000
CUT = 0.3
FEATURES = (
    "log_words", "upper", "digits", "symbols", "bangs", "pipes", "odd_ends", "short", "mean_length", "repeat", "top_word",
    "distinct", "pairs_new", "same_lines", "long_lines", "stops", "commas", "caps_words", "letters", "runs",
)
SYMBOLS = "#$%&*+<=>@^_`{}~\\/[]"
ODD = re.compile(r"[#$%&*!|=~^_+<>\\]{2,}(?=\s|$)")
RUN = re.compile(r"([^\w\s])\1{2,}")


def features(text: str | None) -> list[float]:
    """FEATURES of one text; all are shares or bounded, but for the logs of counts."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = Counter(text)
    letters = upper = 0
    for c, k in counts.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
    by = lambda cs: sum(counts.get(c, 0) for c in cs)
    forms = Counter(words)
    m = max(1, n)
    same = sum(a == b for a, b in pairwise(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    caps = sum(k for w, k in forms.items() if len(w) > 1 and w.isupper())
    short = sum(k for w, k in forms.items() if len(w) <= 3)
    return [
        np.log1p(n) / 10, upper / max(1, letters), by("0123456789") / chars, by(SYMBOLS) / chars, min(1.0, 5 * by("!?") / m), min(1.0, counts.get("|", 0) / m), len(ODD.findall(text)) / m, short / m, min(len(text) / m, 30) / 10,
        same / m, max(forms.values(), default=0) / m, len(forms) / m, pairs / m, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, sum(len(x) > 2000 for x in lines) / max(1, len(lines))),
        by(".") / m, by(",;:") / m, caps / m, letters / chars, min(1.0, len(RUN.findall(text)) / m),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their roots: a linear merit can then bend where small shares matter."""
    return np.concatenate((x, np.sqrt(np.abs(x))), axis=1)


class Ranker:
    def __init__(self, mean=None, scale=None, w=None, cut: float = 0.0, slope: float = 1.0):
        self.mean, self.scale, self.w, self.cut, self.slope = mean, scale, w, cut, slope

    def merit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None or not len(x):
            return np.ones(len(x))
        z = self.slope * (self.merit(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 30, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton's method on the pairs' logistic loss. x[n, features]; y[n], 1 for preferred rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker()
    e = expand(x)
    mean, scale = e.mean(0), e.std(0) + 1e-6
    z = np.clip((e - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        grad = d.T @ (1 - p) / n - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), grad)
        w += step * min(1.0, 5 / max(1e-9, np.linalg.norm(step)))
        if np.abs(step).max() < 1e-6:
            break
    merit = z @ w
    cut = float(np.quantile(merit, len(bad) / (len(good) + len(bad))))
    return Ranker(mean, scale, w, cut, 1.0)


def featurise(docs: DataFrame, extra: str = "") -> DataFrame:
    """doc_id, x (array of FEATURES) and the column `extra` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["x"] = [features(t if isinstance(t, str) else None) for t in pdf["text"]]
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text", *([F.col(extra).cast("int")] if extra else [])).mapInPandas(run, "doc_id long, " + (f"{extra} int, " if extra else "") + "x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ranker:
    """Learn from labelled rows that aren't held out; about `rows` of them, by a hash of doc_id."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    total = known.count()
    part = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), 33) / float(2**31)
    few = F.broadcast(known.where(part < min(1.0, rows / max(1, total))))  # bounded by `rows`
    labelled = docs.select("doc_id", "text").join(few, "doc_id")
    found = docs.select("doc_id").join(few, "doc_id").count()  # over `rows` only where many documents share an id
    own = F.shiftrightunsigned(F.xxhash64("text", F.lit("row")), 33) / float(2**31)
    got = featurise(labelled.where(own < min(1.0, 2 * rows / max(1, found))), "quality").distinct().toPandas()
    if got.empty:
        return Ranker()
    got = got.sort_values(["doc_id", "quality", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c)
    return fit(np.stack(got["x"].to_numpy()), got["quality"].to_numpy())


def predict(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    return map_texts(docs, lambda: lambda texts: {"score": shared.value.score(matrix(texts))}, "score double")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows that score CUT or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    return filter_texts(docs, lambda: lambda texts: shared.value.score(matrix(texts)) >= CUT)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
