import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text[, lang]) with extra columns, over some partitions."""

    def build(rows, parts=3, schema=DOCS, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
        df = spark.createDataFrame(full, schema).repartition(parts)
        if extra:  # names that operators use inside
            df = df.selectExpr("*", "1 as score", "'x' as key", "2 as n", "'y' as node", "3 as row", "'z' as host")
        return df

    return build


@pytest.fixture
def folder(tmp_path):
    """A stand-in for spark.checkpoint.dir's layout: SF-like folder of Parquet tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
