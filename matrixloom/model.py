"""The data model: a sparse matrix is a table of entries with explicit dimensions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SparseFrame:
    """entries: row long, col long, val double, from 0; repeated cells are kept. m and n are given,
    never inferred: rows and columns without an entry count."""

    entries: DataFrame
    m: int
    n: int

    @classmethod
    def of(cls, df: DataFrame, row, col, val, m: int, n: int) -> SparseFrame:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return cls(df.select(c(row).cast("long").alias("row"), c(col).cast("long").alias("col"), c(val).cast("double").alias("val")), m, n)

    def with_entries(self, entries: DataFrame, m: int | None = None, n: int | None = None) -> SparseFrame:
        return replace(self, entries=entries.select("row", "col", "val"), m=self.m if m is None else m, n=self.n if n is None else n)

    def rows(self) -> DataFrame:
        """Every row id, the empty ones too."""
        return self.entries.sparkSession.range(self.m).withColumnRenamed("id", "row")

    def cols(self) -> DataFrame:
        return self.entries.sparkSession.range(self.n).withColumnRenamed("id", "col")

    def nnz(self) -> int:
        return self.entries.count()


@dataclass(frozen=True)
class DenseFrame:
    """A dense matrix by rows: id long, vec array<double> of k numbers."""

    data: DataFrame
    k: int

    @classmethod
    def of(cls, df: DataFrame, key, *columns) -> DenseFrame:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return cls(df.select(c(key).cast("long").alias("id"), F.array(*[c(x).cast("double") for x in columns]).alias("vec")), len(columns))

    def part(self, start: int, size: int) -> DenseFrame:
        """Columns start, ..., start + size - 1."""
        return DenseFrame(self.data.select("id", F.slice("vec", start + 1, size).alias("vec")), min(size, self.k - start))


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
