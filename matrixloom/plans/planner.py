"""Physical choices that Catalyst can't make by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dense side up to this size is broadcast; columns of a dense side that are summed in one aggregate.
BROADCAST_BYTES = 64 << 20
COLUMN_BATCH = 64


def choose_spmm(dense_rows: int, k: int) -> tuple[str, int]:
    """("broadcast" or "shuffle", columns at a time): whether the dense side, or a batch of its
    columns, is small enough to be broadcast."""
    batch = min(k, COLUMN_BATCH)
    return ("broadcast" if dense_rows * batch * 8 <= BROADCAST_BYTES else "shuffle"), batch


def size_checked(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """df with a broadcast hint where its known number of rows is small enough."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def salted_sum(df: DataFrame, keys: list[str], salt: Column, salts: int, **sums: Column) -> DataFrame:
    """Sums by keys in two steps, by (keys, salt) and then by keys: a heavy key is dealt over `salts`
    tasks. For aggregates that Spark combines before the shuffle one step does as well."""
    part = df.groupBy(*keys, F.pmod(salt, F.lit(salts)).alias("_salt")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return part.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in sums])
