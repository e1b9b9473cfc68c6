"""Format conversion: projections, filters and regroupings of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.model import SparseFrame
from matrixloom.operators import scan


def transpose(a: SparseFrame) -> SparseFrame:
    return a.with_entries(a.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), a.n, a.m)


def lower_triangle(a: SparseFrame) -> SparseFrame:
    """The entries on or below the diagonal."""
    return a.with_entries(a.entries.where("row >= col"))


def expand_symmetry(a: SparseFrame, skew: bool = False) -> SparseFrame:
    """Adds the mirror image of what is off the diagonal, negated if skew."""
    other = a.entries.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (-F.col("val") if skew else F.col("val")).alias("val"))
    return a.with_entries(a.entries.unionByName(other))


def expand_lower(a: SparseFrame) -> SparseFrame:
    """expand_symmetry() of a lower triangle; an entry above the diagonal is an error when run."""
    checked = a.entries.withColumn("val", F.when(F.col("row") < F.col("col"), F.raise_error(F.lit("an entry lies above the diagonal"))).otherwise(F.col("val")))
    return expand_symmetry(a.with_entries(checked))


def dedupe_sum(a: SparseFrame) -> SparseFrame:
    return a.with_entries(a.entries.groupBy("row", "col").agg(F.sum("val").alias("val")))


def set_ones(a: SparseFrame) -> SparseFrame:
    return a.with_entries(a.entries.withColumn("val", F.lit(1.0)))


def reorder_rows(a: SparseFrame, permutation: DataFrame) -> SparseFrame:
    """permutation: old, new. A row's entries stay as they are."""
    return a.with_entries(a.entries.join(permutation, a.entries["row"] == permutation["old"]).select(F.col("new").cast("long").alias("row"), "col", "val"))


def quantize_columns(a: SparseFrame, width: int) -> DataFrame:
    """row, window, count: entries of a row in each window of `width` columns."""
    return a.entries.groupBy("row", F.floor(F.col("col") / width).alias("window")).agg(F.count(F.lit(1)).alias("count"))


def pack_rows(a: SparseFrame) -> DataFrame:
    """row, entries (array of col, val, by col): the row-compressed form, rows without entries left out."""
    return a.entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("entries"))


def unpack_rows(packed: DataFrame, m: int, n: int) -> SparseFrame:
    return SparseFrame(packed.select("row", F.inline("entries")).select("row", "col", "val"), m, n)


def row_order(a: SparseFrame) -> DataFrame:
    """Entries dealt by row and sorted by (row, col): the order of a row-compressed matrix."""
    return a.entries.repartition("row").sortWithinPartitions("row", "col")


def row_pointers(a: SparseFrame) -> DataFrame:
    """row, start: how many entries the rows before have."""
    from matrixloom.operators.features import row_degrees

    return scan.prefix_sum(row_degrees(a), scan.id_bucket("row"), ["row"], "degree", "start").select("row", "degree", "start")


def row_swizzle(a: SparseFrame) -> DataFrame:
    """row, rank: rows from the longest to the shortest, ties by row."""
    from matrixloom.operators.features import row_degrees

    ranked = row_degrees(a).withColumn("_neg", -F.col("degree"))
    return scan.prefix_count(ranked, scan.value_bucket(ranked, "_neg"), ["_neg", "row"], "rank").select("row", "degree", "rank")


def head_tail_interleave(ranked: DataFrame, m: int, block: int) -> DataFrame:
    """From row, rank: slot, where one row from the front and block - 1 from the back follow one another."""
    blocks = -(-m // block)
    back = F.lit(m - 1) - F.col("rank")
    slot = F.when(F.col("rank") < blocks, F.col("rank") * block).otherwise(F.floor(back / (block - 1)) * block + 1 + back % (block - 1)) if block > 1 else F.col("rank")
    return ranked.withColumn("slot", slot.cast("long"))


def row_chunks(a: SparseFrame, size: int) -> DataFrame:
    """row, chunk, entries: each row cut into runs of `size` entries; an empty row has one empty chunk."""
    from matrixloom.operators.features import walk

    cut = walk(a).withColumn("chunk", F.floor((F.col("at") - 1) / size)).groupBy("row", "chunk").agg(F.count(F.lit(1)).alias("entries"))
    return a.rows().join(cut, "row", "left").select("row", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("entries", F.lit(0)).alias("entries"))


def segments_and_residue(a: SparseFrame, segment: int, least: int) -> DataFrame:
    """row, chunk, entries, kind: full and partial segments; a last part under `least` is residue."""
    kind = F.when(F.col("entries") >= least, "segment").otherwise("residue")
    return row_chunks(a, segment).where("entries > 0").withColumn("kind", kind)


def cost_groups(a: SparseFrame, size: int, row_cost: float) -> DataFrame:
    """row, work_group: consecutive rows packed by entries plus a cost for each row."""
    from matrixloom.operators.features import row_degrees

    costed = row_degrees(a).withColumn("_w", F.col("degree") + F.lit(float(row_cost)))
    return scan.prefix_sum(costed, scan.id_bucket("row"), ["row"], "_w", "_at").select("row", "degree", F.floor(F.col("_at") / size).alias("work_group"))


def condense_windows(a: SparseFrame, height: int, width: int) -> DataFrame:
    """window, columns, tiles: distinct columns of each window of `height` rows, and tiles of `width` that hold them."""
    return (a.entries.groupBy(F.floor(F.col("row") / height).alias("window")).agg(F.count_distinct("col").alias("columns"))
        .withColumn("tiles", F.ceil(F.col("columns") / width)))


def condensed_entries(a: SparseFrame, height: int) -> DataFrame:
    """window, row, col, slot: columns renumbered densely in each window of rows."""
    w = Window.partitionBy("window").orderBy("col")
    return a.entries.withColumn("window", F.floor(F.col("row") / height)).withColumn("slot", F.dense_rank().over(w) - 1).select("window", "row", "col", "slot")


def panel_tiles(a: SparseFrame, height: int, least: int) -> DataFrame:
    """panel, col, entries, dense: columns of a row panel with `least` entries or more are dense."""
    counts = a.entries.groupBy(F.floor(F.col("row") / height).alias("panel"), "col").agg(F.count(F.lit(1)).alias("entries"))
    return counts.withColumn("dense", F.col("entries") >= least)
