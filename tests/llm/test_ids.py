"""Ids and other integer columns stay what they are, beside nulls, in every operator and pipeline stage."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import bpe, elias_fano, exact_dedup, html_text, language_id, multi_index, near_dup, packing, quality, sharding, simhash

BIG = 2**53 + 1
IDS = [BIG, None, -BIG, 7]
TEXTS = ["the quick brown fox and the dog", "one two three four five six", "a house of my friend in the town", "again and again it runs away"]


@pytest.fixture
def few(docs):
    return docs(list(zip(IDS, TEXTS, strict=True)), 1).withColumn("n_chars", F.col("doc_id"))


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=str)


def test_operators(spark, docs, few, tmp_path):
    want = sorted(IDS, key=str)
    model, ranker = language_id.train(few), quality.Ranker()
    assert ids(language_id.predict(few, model)) == want
    assert ids(exact_dedup.exact_dedup(few)) == want and ids(exact_dedup.exact_dedup(few), "keep_id") == want
    assert ids(quality.predict(few, ranker)) == want
    elias_fano.write_ids(few, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    assert ids(elias_fano.read_ids(spark, str(tmp_path / "ids"))) == want
    assert ids(simhash.groups(simhash.fingerprints(few))) == want
    assert ids(packing.pack(few, P.path("word_bpe_49k.json")).select("doc_id").distinct()) == want
    assert ids(sharding.shard_documents(few, [1.0] * 8)) == want
    assert ids(bpe.digests(few)) == want and ids(bpe.encode(few)) == want
    pages = spark.createDataFrame([(i, "http://a/", f"<p>{t}</p>") for i, t in zip(IDS, TEXTS, strict=True)], "page_id long, url string, html string").coalesce(1)
    assert ids(html_text.extract_pages(pages), "page_id") == want
    vectors = spark.createDataFrame([(i, [1.0, float(n)]) for n, i in enumerate(IDS)], "vec_id long, embedding array<float>").coalesce(1)
    found = multi_index.search(vectors, F.col("id") == BIG).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(BIG, 7), (BIG, -BIG)}


def test_stages(few):
    want = sorted(IDS, key=str)
    kept = [
        quality.keep_good(few, quality.Ranker()),
        language_id.keep_known(few, language_id.train(few), 0.0),
        exact_dedup.drop_copies(few),
        near_dup.drop_near_duplicates(few),
    ]
    for df in kept:
        assert ids(df) == want and ids(df, "n_chars") == want and df.columns == few.columns
    assert len(corpus_pipeline.STAGES) == 5
