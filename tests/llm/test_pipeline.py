import corpus_pipeline
import numpy as np

import __spark_entry__ as entry

EN = "the quick brown fox jumps over the lazy dog and then it runs away from the house of my friend".split()


def test_names():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "exact dedup", "SimHash near-dedup", "packing"]
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, docs, folder):
    rng = np.random.default_rng(0)
    clean = [(i, " ".join(rng.choice(EN, 80)) + f" item {i}.") for i in range(120)]
    junk = [(200 + i, " ".join(w.upper() + "!!!###" for w in rng.choice(EN, 80))) for i in range(40)]
    words = clean[7][1].split()
    words[40] = "changed"
    copies = [(300, clean[3][1] + " \n"), (301, clean[3][1].replace(" ", "  ")), (302, " ".join(words))]
    blank = [(400, None), (401, "12 34")]
    rows = docs([*clean, *junk, *copies, *blank], extra=False)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    d = folder(documents=rows, labels=labels)
    seen, now = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        seen[name] = now
        if name != "packing":
            assert now.columns == rows.columns
            now.write.mode("overwrite").parquet(f"{d}/{name}.parquet")
            now = spark.read.parquet(f"{d}/{name}.parquet")
            seen[name] = {r["doc_id"] for r in now.collect()}
    assert not seen["quality classifier"] & set(range(200, 240)) and len(seen["quality classifier"] & set(range(120))) >= 115
    assert not seen["language ID"] & {400, 401}
    # of the copies the longest stays; of the near copies the one with the smallest id
    assert len(seen["exact dedup"] & {3, 300, 301}) == 1 and 301 in seen["exact dedup"]
    assert 7 in seen["SimHash near-dedup"] and 302 not in seen["SimHash near-dedup"]
    assert {r["doc_id"] for r in seen["packing"].collect()} == seen["SimHash near-dedup"]
    again = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in again.select("doc_id").collect()} == seen["SimHash near-dedup"]
