"""Lines of benchmark logs: one line a run, written by line() and read by parse()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line that benchmark programs print, and the pattern that reads it.
FORMAT = "%s kernel - matrix: %s (%d rows, %d cols, %d nnz), read: %.4f, coo_to_csr: %.4f, format_conversion: %.4f, format: %s, k: %d, system: %s, gflops: %.2f"
PATTERN = (
    r"^(\w+) kernel - matrix: (\S+) \((\d+) rows, (\d+) cols, (\d+) nnz\), read: ([\d.]+), coo_to_csr: ([\d.]+), "
    r"format_conversion: ([\d.]+), format: ([\w\-]+), k: (\d+), system: ([\w\-]+), gflops: ([\d.]+)\s*$"
)
COLUMNS = (
    ("kernel", "string"), ("matrix", "string"), ("rows", "long"), ("cols", "long"), ("nnz", "long"), ("read", "double"), ("coo_to_csr", "double"),
    ("convert_to_format", "double"), ("format", "string"), ("k", "int"), ("system", "string"), ("gflops", "double"),
)


def line(*columns: Column) -> Column:
    return F.format_string(FORMAT, *columns)


def parse(lines: DataFrame, prefix: str = "", recode: dict[str, str] | None = None) -> DataFrame:
    """COLUMNS of the lines that match; others go. The matrix loses `prefix` and its extension; formats
    are recoded, those not named stay."""
    # one match a line: the groups come back joined, behind a mark that no other line begins with; as the
    # row of a generator they aren't worked out anew for each column or filter that asks for one
    joined = F.regexp_replace("value", PATTERN, "\u0002\u0001" + "\u0001".join(f"${i + 1}" for i in range(len(COLUMNS))))
    parts = lines.select(F.explode(F.array(F.split(joined, "\u0001"))).alias("p")).where(F.get("p", F.lit(0)) == "\u0002")
    out = parts.select(*[F.get("p", F.lit(i + 1)).cast(t).alias(n) for i, (n, t) in enumerate(COLUMNS)])
    name = F.regexp_replace(F.when(F.col("matrix").startswith(prefix), F.substring("matrix", len(prefix) + 1, 1_000_000)).otherwise(F.col("matrix")), r"(?<=[^/.])\.[^./]*$", "")
    out = out.withColumn("matrix", name)
    if recode:
        table = F.create_map(*[F.lit(x) for kv in recode.items() for x in kv])
        out = out.withColumn("format", F.coalesce(F.try_element_at(table, F.col("format")), F.col("format")))
    return out


def read_logs(spark: SparkSession, paths: str | list[str], prefix: str = "", recode: dict[str, str] | None = None) -> DataFrame:
    return parse(spark.read.text(paths), prefix, recode)
