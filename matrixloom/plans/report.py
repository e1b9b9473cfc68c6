"""Analytics over benchmark runs: repeats, footprints, quartiles, pivots, best versions, bins, rooflines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LLC_MB = 128
#: Left-closed bins of sparsity in percent; the first is labelled from 50.
SPARSITY_EDGES = (30, 60, 70, 80, 90, 95, 98, 100)
KEYS = ("matrix", "format", "system", "k")


def runs_avg(runs: DataFrame) -> DataFrame:
    """One row for each matrix, format, system and k: means over repeats; the shape as whole numbers."""
    means = runs.groupBy(*KEYS).agg(*[F.avg(c).cast("long").alias(c) for c in ("rows", "cols", "nnz")], F.avg("gflops").alias("gflops"), F.count(F.lit(1)).alias("repeats"))
    return means.withColumns({"mem_footprint": footprint(), "sparsity": sparsity()})


def footprint() -> Column:
    """Megabytes of the row-compressed form with 4-byte indexes and values of 4 bytes."""
    return F.bround((8 * F.col("nnz") + 4 * (F.col("rows") + 1)) / (1024.0 * 1024.0), 4)


def sparsity() -> Column:
    return F.bround((1 - F.col("nnz") / (F.col("rows").cast("double") * F.col("cols"))) * 100, 4)


def with_total_footprint(runs: DataFrame, kernel: str = "SpMM") -> DataFrame:
    dense = 2.0 * (F.col("rows") if kernel == "SpMM" else F.col("nnz")) * F.col("k") * 4 / (1024.0 * 1024.0)
    return runs.withColumn("mem_footprint_total", F.bround(F.col("mem_footprint") + dense, 0))


def with_llc_split(runs: DataFrame, cpu: Column, llc_mb: float = LLC_MB) -> DataFrame:
    """>LLC or <LLC where `cpu` holds, else the word NULL."""
    return runs.withColumn("LLC_split", F.when(cpu, F.when(F.col("mem_footprint_total") > llc_mb, ">LLC").otherwise("<LLC")).otherwise("NULL"))


def dlmc_type(matrix: str | Column = "matrix") -> Column:
    """The first two words, by _, of what stands before the first slash."""
    head = F.substring_index(matrix, "/", 1)
    return F.array_join(F.slice(F.split(head, "_"), 1, 2), "_")


def keep_formats(runs: DataFrame, formats: list[str]) -> DataFrame:
    return runs.where(F.col("format").isin(formats))


def contains_any_case(c: str, part: str) -> Column:
    """Null counts as no."""
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def drop_versions(runs: DataFrame, kept: dict[str, str]) -> DataFrame:
    """Of formats whose name has a key (in any case) only the kept one stays."""
    bad = reduce(lambda x, y: x | y, [contains_any_case("format", k) & (F.col("format") != v) for k, v in kept.items()], F.lit(False))
    return runs.where(~bad)


def quartiles(runs: DataFrame, by: list[str], value: str = "gflops", matrix: str = "matrix") -> DataFrame:
    """q1, median, q3, max (linear interpolation, half to even at two places), n and distinct matrices of each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = runs.groupBy(*by).agg(q.alias("_q"), F.max(value).alias("_max"), F.count(F.lit(1)).alias("n"), F.count_distinct(matrix).alias("matrices"))
    return own.select(*by, *[F.bround(F.col("_q")[i], 2).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.bround("_max", 2).alias("max"), "n", "matrices")


def quartiles_with_split(runs: DataFrame, by: list[str], split: str, value: str = "gflops") -> DataFrame:
    """quartiles() of each group and of its parts by `split` (null: the whole), in one pass."""
    sets = runs.groupingSets([[*[F.col(c) for c in by]], [*[F.col(c) for c in by], F.col(split)]], *by, split)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    own = sets.agg(q.alias("_q"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"), F.count_distinct("matrix").alias("matrices"))
    return own.select(*by, split, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max", "n", "matrices")


def boxplot(runs: DataFrame, by: list[str], value: str = "gflops") -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and fliers' number."""
    v = F.col(value)
    q = runs.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    both = runs.select(*by, value).join(q, by)
    return both.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("fliers"))


def pivot_gflops(runs: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each matrix, a column for each format_k named; two values for a cell are an error."""
    keyed = runs.withColumn("_c", F.concat_ws("_", "format", F.col("k").cast("string")))
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell has two values"))).otherwise(F.first("gflops"))
    return keyed.groupBy("matrix").pivot("_c", columns).agg(one)


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def best_version(runs: DataFrame, family: str) -> DataFrame:
    """matrix, k, format: of the formats whose name has `family`, the fastest; ties go to the name that sorts first."""
    own = runs.where(F.col("format").contains(family))
    return own.groupBy("matrix", "k").agg(F.min_by("format", F.struct((-F.col("gflops")).alias("g"), "format")).alias("format"))


def best_version_votes(runs: DataFrame, family: str, ks: list[int]) -> DataFrame:
    """format and, for each k, on how many matrices it is the fastest."""
    votes = best_version(runs, family).groupBy("format").pivot("k", ks).agg(F.count(F.lit(1)))
    return votes.select("format", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"k{k}") for k in ks])


def with_sparsity_level(runs: DataFrame, value: str = "sparsity") -> DataFrame:
    """sparsity_level: [50-60), [60-70), ...; null under 30 and at 100."""
    v, level = F.col(value), F.lit(None).cast("string")
    for a, b in reversed(list(zip(SPARSITY_EDGES, SPARSITY_EDGES[1:], strict=False))):
        level = F.when((v >= a) & (v < b), f"[{50 if a == 30 else a}-{b})").otherwise(level)
    return runs.withColumn("sparsity_level", level)


def with_counters(runs: DataFrame, counters: DataFrame) -> DataFrame:
    """runs with the columns of a table of measured counters (as spark.read.csv gives it), by matrix, format and k; null where none was taken."""
    return runs.join(counters, ["matrix", "format", "k"], "left")


def arithmetic_intensity(runs: DataFrame) -> DataFrame:
    """Operations of a product over the bytes that it must move at least."""
    moved = 8 * F.col("nnz") + 4 * (F.col("rows") + 1) + 4.0 * F.col("k") * (F.col("rows") + F.col("cols"))
    return runs.withColumn("intensity", 2.0 * F.col("nnz") * F.col("k") / moved)


def roofline_curve(roofs: DataFrame, points: int = 100, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """label, ai, gflops: min(ai * bandwidth, peak) at log-spaced intensities, for each bandwidth. roofs: kind, label, value."""
    peak = roofs.where("kind = 'gflops'").agg(F.max("value").alias("peak"))
    bands = roofs.where("kind = 'gbytes'").select("label", F.col("value").alias("bandwidth"))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * ((high - low) / (points - 1))))
    return bands.crossJoin(F.broadcast(peak)).select("label", F.explode(at).alias("ai"), "bandwidth", "peak").select("label", "ai", F.least(F.col("ai") * F.col("bandwidth"), F.col("peak")).alias("gflops"))


def roofline_knees(roofs: DataFrame) -> DataFrame:
    """label, knee: the intensity where a bandwidth's roof meets the peak."""
    peak = roofs.where("kind = 'gflops'").agg(F.max("value").alias("peak"))
    return roofs.where("kind = 'gbytes'").crossJoin(F.broadcast(peak)).select("label", (F.col("peak") / F.col("value")).alias("knee"))
