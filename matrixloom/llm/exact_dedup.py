"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row for each digest (partial aggregation, so a hot text costs a row for
each task), sort-merge anti-joined with the index, and what is new is appended to the index. The
index is a bucketed Parquet table: neither the anti-join nor the later lookup moves it. Its folder
carries its number of buckets, so that whoever opens it again joins the right files.

Defined results: a null text counts as empty; all empty and all-blank texts are equal to one
another; a null doc_id is smaller than any other; rows that repeat a doc_id are one document and
share its verdict, but drop_copies() keeps one row of them; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, lookup, named_table, shared_dir, table

BLANKS = " \t\n\x0b\x0c\r"
#: About so many rows of 64-digit digests are one bucket file.
ROWS_A_BUCKET = 2_000_000
LEAST_BUCKETS = 12
#: In an index's folder, the file with its number of buckets; Spark's readers pass over such names.
BUCKETS_FILE = "_buckets"
#: Dropped rows up to which they are broadcast, about 100 bytes each.
BROADCAST_COPIES = 200_000


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text in UTF-8 without the blanks of [\\x20\\x09-\\x0D]."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, n_points (code points of the original text) of every row."""
    return docs.select(
        "doc_id", digest(F.col("text")).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    )


class DigestIndex:
    """One row for each text seen: text_sha256, keep_id (who stays), n_points, group_size (rows of
    the batch that brought it). A folder opened again after the session has ended serves on, with the
    number of buckets that it was made with; another number asked for is an error."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._settled(buckets)
        self.name = named_table(f"digest_index_{uuid.uuid4().hex}")
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, n_points BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _settled(self, buckets: int | None) -> int:
        """The folder's own number of buckets; a new folder gets `buckets`."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        file, fs = jvm.org.apache.hadoop.fs.Path(folder, BUCKETS_FILE), folder.getFileSystem(conf)
        if fs.exists(file):
            stream = fs.open(file)
            own = int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            if buckets not in (None, own):
                raise ValueError(f"{self.path} has {own} buckets, not {buckets}")
            return own
        if fs.exists(folder) and len(fs.listStatus(folder)):
            raise ValueError(f"{self.path} holds files but not its number of buckets")
        stream = fs.create(file, False)
        stream.write(bytearray(str(buckets or LEAST_BUCKETS), "ascii"))
        stream.close()
        return buckets or LEAST_BUCKETS

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """batch: as digests() gives it. Of equal texts the longest original, then the smallest
        doc_id, stays; texts that the index has keep the document that it names."""
        best = batch.groupBy("text_sha256").agg(
            F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id")).alias("b"),
            F.count(F.lit(1)).alias("group_size"),
        )
        new = best.join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (new.select("text_sha256", F.col("b.doc_id").cast("long").alias("keep_id"), (-F.col("b.n")).alias("n_points"), "group_size")
            .repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
            .option("path", self.path).saveAsTable(self.name))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, the dropped ones too."""
    spark = docs.sparkSession
    batch = cut(digests(docs), "digests")
    total = batch.count()
    index = index or DigestIndex(spark, shared_dir(spark, "digest_index"), max(LEAST_BUCKETS, total // ROWS_A_BUCKET))
    index.append(batch)
    # what the index says of the batch's own digests, with their counts in the batch: those that are hot there are few
    own = batch.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    known = cut(index.rows().select("text_sha256", "keep_id", "group_size").hint("merge").join(own, "text_sha256"), "known")
    out = lookup(batch.select("doc_id", "text_sha256"), known, "text_sha256", "_rows", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, with all their columns. A row is told by id and digest: another text under
    the id of a dropped copy stays. Of rows that repeat the id and the digest of the document that stays
    one does, the longest, then the smallest text."""
    verdicts = exact_dedup(docs, index)
    per = cut(verdicts.groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n")), "verdicts")
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (digest(docs["text"]) == F.col("_sha"))

    def sides(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_COPIES else df

    repeated = per.where("kept and n > 1")
    gone = cut(named(per.where("not kept or n > 1")), "copies")
    out = docs.join(sides(gone), same, "left_anti").select(*[docs[c] for c in docs.columns])
    if repeated.isEmpty():
        return out
    rows = docs.join(sides(cut(named(repeated), "repeats")), same, "left_semi")
    whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])  # combined in each task before it's dealt
    one = rows.groupBy(docs["doc_id"].alias("_id"), digest(docs["text"]).alias("_sha")).agg(F.min_by(whole, F.struct(-F.length(F.coalesce(docs["text"], F.lit(""))), docs["text"])).alias("w"))
    return out.unionByName(one.select(*[F.col(f"w.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) text_sha256 from documents),
     w as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) keep_id,
                  count(*) over (partition by text_sha256) group_size from d)
select doc_id, keep_id, cast(group_size as bigint) group_size, doc_id = keep_id kept, text_sha256 from w
"""
