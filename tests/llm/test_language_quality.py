import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrixloom.llm import language_id as L
from matrixloom.llm import quality as Q
from matrixloom.llm.common import is_held_out

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the house"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft danach aus dem haus"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом убегает из дома"


def slow_viterbi(s, fresh, switch):
    n, k = s.shape
    best, back = s[0].copy(), []
    for t in range(1, n):
        step = best[:, None] - (0 if fresh[t] else switch) * (1 - np.eye(k))
        back.append(step.argmax(0))
        best = step.max(0) + s[t]
    return best.max()


def value(s, fresh, switch, path):
    return sum(s[t, p] for t, p in enumerate(path)) - switch * sum(path[t] != path[t - 1] and not fresh[t] for t in range(1, len(path)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.integers(1, 4), st.integers(0, 2**31), st.floats(0, 6))
def test_viterbi(n, k, seed, switch):
    rng = np.random.default_rng(seed)
    s, fresh = rng.normal(size=(n, k)) * 3, rng.random(n) < 0.1
    path = L.viterbi(s, fresh, switch)
    assert value(s, fresh, switch, path) == pytest.approx(slow_viterbi(s, fresh, switch), abs=1e-6)


@pytest.fixture(scope="module")
def trained(docs):
    rows = [(i, {"en": EN, "de": DE, "ru": RU}[x], x) for i, x in enumerate(["en", "de", "ru"] * 20)]
    return L.train(docs([*rows, (1000, None, "en"), (1001, "the", None), (1002, "", "fr")]))


def test_labels(trained, docs):
    rows = [(1, "the dog and the fox"), (2, "der hund und das haus"), (3, "собака и лиса"), (4, None), (5, ""), (6, "12 !! 3"), (7, "the " * 60000), (7, "the " * 60000), (None, "over the house")]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in L.predict(docs(rows), trained).collect()}
    assert set(got) == {(1, "en"), (2, "de"), (3, "ru"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (None, "en")}
    assert got[4, "und"] == 0 and got[7, "en"] == 1 and all(0 <= v <= 1 for v in got.values())


def test_spans(trained):
    text = f"{EN}. {DE}; {RU}"
    spans = trained.spans(text)
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert spans[1][0] == len(EN) + 2 and spans[-1][1] == len(text) and trained.spans("7 8") == []


def test_scripts_narrow(trained):
    s, _, _ = trained.word_scores("хаус house")
    en, de, ru = (trained.langs.index(x) for x in ("en", "de", "ru"))
    assert s[0].argmax() == ru and s[1, ru] < min(s[1, en], s[1, de])


def test_nothing_to_learn(docs):
    model = L.train(docs([(1, "a", None)]))
    assert [r["lang_pred"] for r in L.predict(docs([(1, "a b")]), model).collect()] == ["und"]
    assert L.predict(docs([]), model).count() == 0


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    from matrixloom.llm.common import held_out

    ids = [None, 0, 1, 17, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out(F.col("doc_id"))).collect()]
    assert got == [is_held_out(i) for i in ids]


def test_quality(spark, docs):
    rng = np.random.default_rng(1)
    words = EN.split()
    good = [" ".join(rng.choice(words, 60)) + "." for _ in range(150)]
    bad = [" ".join(w + "$$$" for w in rng.choice(words, 60)) for _ in range(50)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows] + [(1, None, 0), (99999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    ranker = Q.train(docs(rows), labels)
    more = rows + [(500, None), (501, ""), (502, "the $$$ " * 30000), (None, "fine text"), (3, good[3])]
    got = [(r["doc_id"], r["score"]) for r in Q.predict(docs(more), ranker).collect()]
    score = dict(got)
    assert len(got) == len(more) and all(0 <= s <= 1 for _, s in got)
    own = [i for i, _ in rows if is_held_out(i)]
    assert np.mean([(score[i] >= Q.CUT) == (i < 150) for i in own]) > 0.95
    kept = Q.keep_good(docs(rows), ranker)
    assert kept.columns == docs(rows).columns and 140 < kept.count() < 160


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in Q.predict(docs([(1, "a")]), Q.train(docs([(1, "a")]), labels)).collect()] == [1.0]
    assert Q.predict(docs([]), Q.Ranker()).count() == 0
