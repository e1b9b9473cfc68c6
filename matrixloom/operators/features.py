"""Structural features: tables by entry, by row and by column, and what is said of a whole matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.model import SparseFrame
from matrixloom.operators import hist, scan

MB = 1024.0 * 1024.0
#: Rows of at least HEAVY entries, the HEAVY_ROWS largest, are worked on in up to PARTS parts each; any
#: other row has less than 1 / HEAVY_ROWS of all entries.
HEAVY, HEAVY_ROWS, PARTS = 4096, 1024, 256


def row_degrees(a: SparseFrame) -> DataFrame:
    """row, degree, for every row."""
    counts = a.entries.groupBy("row").agg(F.count(F.lit(1)).alias("degree"))
    return a.rows().join(counts, "row", "left").select("row", F.coalesce("degree", F.lit(0)).alias("degree"))


def col_degrees(a: SparseFrame) -> DataFrame:
    counts = a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("degree"))
    return a.cols().join(counts, "col", "left").select("col", F.coalesce("degree", F.lit(0)).alias("degree"))


def row_spans(a: SparseFrame) -> DataFrame:
    """row, degree, bandwidth (last column less first), scatter (degree / bandwidth, or 0), for every row."""
    own = a.entries.groupBy("row").agg(F.count(F.lit(1)).alias("d"), (F.max("col") - F.min("col")).alias("b"))
    zero = F.lit(0)
    spans = a.rows().join(own, "row", "left").select("row", F.coalesce("d", zero).alias("degree"), F.coalesce("b", zero).alias("bandwidth"))
    return spans.withColumn("scatter", F.when(F.col("bandwidth") > 0, F.col("degree") / F.col("bandwidth")).otherwise(F.lit(0.0)))


def short_rows(a: SparseFrame, under: int) -> DataFrame:
    """One row: rows of fewer than `under` entries (empty ones too), their entries, and both as percentages."""
    short = F.col("degree") < under
    return row_degrees(a).agg(F.count_if(short).alias("rows"), F.coalesce(F.sum(F.when(short, F.col("degree"))), F.lit(0)).alias("nnz"), F.count(F.lit(1)).alias("_m"), F.sum("degree").alias("_nnz")).select(
        "rows", "nnz", (F.col("rows") * 100.0 / F.col("_m")).alias("rows_percent"), (F.col("nnz") * 100.0 / F.col("_nnz")).alias("nnz_percent"),
    )


def row_footprints(a: SparseFrame, under: int) -> DataFrame:
    """One row: megabytes of the row-compressed whole, of its short rows and of the rest (8-byte values, 4-byte indexes)."""
    short = F.col("degree") < under
    size = lambda nnz, rows: ((nnz * 12 + (rows + 1) * 4) / MB)
    sums = row_degrees(a).agg(F.sum("degree").alias("nnz"), F.count(F.lit(1)).alias("m"), F.sum(F.when(short, F.col("degree")).otherwise(0)).alias("s_nnz"), F.count_if(short).alias("s_m"))
    c = F.col
    return sums.select(size(c("nnz"), c("m")).alias("mb"), size(c("s_nnz"), c("s_m")).alias("short_mb"), size(c("nnz") - c("s_nnz"), c("m") - c("s_m")).alias("long_mb"))


def filled_rows(a: SparseFrame) -> DataFrame:
    """row, degree, first_col, last_col of the rows with entries."""
    return a.entries.groupBy("row").agg(F.count(F.lit(1)).alias("degree"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def _heavy(a: SparseFrame, window: int) -> DataFrame:
    """row, _first, _width of the heavy rows: where a row's parts begin, and how many columns one has. HEAVY_ROWS at most."""
    c = F.col
    return F.broadcast(
        filled_rows(a).where(c("degree") >= HEAVY).orderBy(F.desc("degree"), "row").limit(HEAVY_ROWS)
        .select("row", c("first_col").alias("_first"), F.greatest(F.ceil((c("last_col") - c("first_col") + 1) / PARTS), F.lit(window + 1)).alias("_width"))
    )


def _part(shift: int) -> Column:
    return F.expr(f"(col + {shift} - _first) div _width")


def _in_parts(a: SparseFrame, heavy: DataFrame, window: int) -> DataFrame:
    """row, col, _home, _part: every entry in its part (0 but in heavy rows), and in those it is within `window` columns of."""
    spread = F.when(F.col("_first").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(_part(0), _part(-window), _part(window))))
    return a.entries.select("row", "col").join(heavy, "row", "left").select("row", "col", F.coalesce(_part(0), F.lit(0)).alias("_home"), F.explode(spread).alias("_part"))


def walk(a: SparseFrame, window: int = 0, max_gap: int = 0) -> DataFrame:
    """Every entry along its row: row, col, before and after (columns to the last and next entry, null
    where there is none), neighbours (others within `window` columns), at (its number in the row, from 1),
    run (number, from 1, of its run: entries with gaps up to max_gap + 1) and start (`at` of the run's first).

    One shuffle by row. Heavy rows are cut by column into parts; a part holds the entries within `window`
    of it besides, and what passes between parts comes from a broadcast table of one row a part."""
    c, one, heavy = F.col, F.lit(1), _heavy(a, window)
    w = Window.partitionBy("row", "_part").orderBy("col")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    cut = a.entries.select("row", "col").join(heavy, "row").select("row", "col", _part(0).alias("_part"))
    marked = cut.withColumns({"_new": F.coalesce(c("col") - F.lag("col").over(w) > max_gap + 1, F.lit(True)), "_n": F.row_number().over(w)})
    parts = marked.groupBy("row", "_part").agg(F.count(one).alias("n"), F.min("col").alias("lo"), F.max("col").alias("hi"), F.count_if("_new").alias("news"), F.max(F.when(c("_new"), c("_n"))).alias("start"))
    by = Window.partitionBy("row").orderBy("_part")  # PARTS rows at most
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_last": F.lag("hi").over(by), "_next": F.lead("lo").over(by), "_n0": F.sum("n").over(past)})
    parts = parts.withColumn("news", c("news") - F.coalesce((c("lo") - c("_last") <= max_gap + 1).cast("int"), F.lit(0)))
    parts = parts.withColumns({"_runs0": F.sum("news").over(past), "_start0": F.last(F.when(c("news") > 0, F.coalesce("_n0", F.lit(0)) + c("start")), ignorenulls=True).over(past)})
    passed = F.broadcast(parts.select("row", "_part", "_last", "_next", "_n0", "_runs0", "_start0"))

    known = _in_parts(a, heavy, window).join(passed, ["row", "_part"], "left")
    own = c("_part") == c("_home")
    near = known.withColumns({
        "before": c("col") - F.coalesce(F.lag("col").over(w), c("_last")), "after": F.coalesce(F.lead("col").over(w), c("_next")) - c("col"),
        "neighbours": F.count(one).over(w.rangeBetween(-window, window)) - 1, "at": F.coalesce("_n0", F.lit(0)) + F.count_if(own).over(so_far),
    }).withColumn("_new", own & F.coalesce(c("before") > max_gap + 1, F.lit(True)))
    runs = near.withColumns({"run": F.coalesce("_runs0", F.lit(0)) + F.count_if("_new").over(so_far), "start": F.coalesce(F.max(F.when(c("_new"), c("at"))).over(so_far), "_start0")})
    return runs.where(own).select("row", "col", "before", "after", "neighbours", "at", "run", "start")


def distant_nonzeros(a: SparseFrame, max_distance: int) -> DataFrame:
    """One row, distant: entries over max_distance + 1 columns from both neighbours in the row."""
    far = lambda c: F.coalesce(F.col(c) > max_distance + 1, F.lit(True))
    return walk(a).agg(F.count_if(far("before") & far("after")).alias("distant"))


def row_neighbours(a: SparseFrame, window: int = 1) -> DataFrame:
    """row, col, neighbours: other entries of the row within `window` columns."""
    w = Window.partitionBy("row", "_part").orderBy("col").rangeBetween(-window, window)
    return _in_parts(a, _heavy(a, window), window).withColumn("neighbours", F.count(F.lit(1)).over(w) - 1).where("_part = _home").select("row", "col", "neighbours")


def next_filled_row(a: SparseFrame) -> DataFrame:
    """row, degree, first_col, last_col, next_row, next_first_col: of the rows with entries, each and the next."""
    rows = filled_rows(a).withColumn("_own", F.struct("row", "first_col"))
    both = scan.with_next(rows, scan.id_bucket("row"), ["row"], "_own", "_next")
    return both.select("row", "degree", "first_col", "last_col", F.col("_next.row").alias("next_row"), F.col("_next.first_col").alias("next_first_col"))


def row_tails(a: SparseFrame) -> DataFrame:
    """row, degree, first_col, last_col, tail: of the rows with entries, and the columns from the last entry to the next row's first; 0 for the last row."""
    return next_filled_row(a).select("row", "degree", "first_col", "last_col", F.coalesce(F.abs(F.col("next_first_col") - F.col("last_col")), F.lit(0)).alias("tail"))


def cross_row_matches(a: SparseFrame, window: int = 1) -> DataFrame:
    """row, degree, matches: entries with one of the next filled row within `window` columns. A band
    semi-join: buckets of window + 1 columns, and their two neighbours, make it an equi-join."""
    rows = next_filled_row(a)
    width = window + 1
    here = a.entries.join(rows.select("row", "next_row"), "row").where("next_row is not null").select("row", "col", "next_row")
    left = here.withColumn("band", F.floor(F.col("col") / width))
    there = a.entries.select(F.col("row").alias("next_row"), F.col("col").alias("other")).distinct()
    right = there.withColumn("band", F.explode(F.array(*[(F.floor(F.col("other") / width) + i).cast("long") for i in (-1, 0, 1)])))
    hit = left.alias("l").join(right.alias("r"), (F.col("l.next_row") == F.col("r.next_row")) & (F.col("l.band") == F.col("r.band")) & (F.abs(F.col("l.col") - F.col("r.other")) <= window), "left_semi")
    counts = hit.groupBy("row").agg(F.count(F.lit(1)).alias("matches"))
    return rows.select("row", "degree").join(counts, "row", "left").select("row", "degree", F.coalesce("matches", F.lit(0)).alias("matches"))


def cross_row_similarity(a: SparseFrame, window: int = 1) -> DataFrame:
    """One row, cross_row_similarity: the mean over filled rows of the share of matched entries; the last row has none."""
    return cross_row_matches(a, window).agg(F.avg(F.col("matches") / F.col("degree")).alias("cross_row_similarity"))


def column_distances(a: SparseFrame) -> DataFrame:
    """row, col, distance: columns to the next entry in row-major order, across rows; 0 for the last."""
    inner = walk(a).where("after is not null").select("row", "col", F.col("after").alias("distance"))
    return inner.unionByName(row_tails(a).select("row", F.col("last_col").alias("col"), F.col("tail").alias("distance")))


def _ends_run(max_gap: int) -> Column:
    return F.coalesce(F.col("after") > max_gap + 1, F.lit(True))


def column_groups(a: SparseFrame, max_gap: int = 0) -> DataFrame:
    """row, group, size, distance: runs of a row's entries with gaps up to max_gap + 1, and each run's
    distance to the next entry in row-major order."""
    last = walk(a, 0, max_gap).where(_ends_run(max_gap)).select("row", F.col("run").alias("group"), (F.col("at") - F.col("start") + 1).alias("size"), "after", F.when(F.col("after").isNull(), F.col("row")).otherwise(-F.col("at")).alias("_key"))
    tails = row_tails(a).select(F.col("row").alias("_key"), "tail")  # keys of a row's other runs are below 0 and spread
    return last.join(tails, "_key", "left").select("row", "group", "size", F.coalesce("after", "tail").alias("distance"))


def groups_per_row(a: SparseFrame, max_gap: int = 0) -> DataFrame:
    counts = walk(a, 0, max_gap).groupBy("row").agg(F.max("run").alias("groups"))
    return a.rows().join(counts, "row", "left").select("row", F.coalesce("groups", F.lit(0)).alias("groups"))


MOMENTS = ("n", "min", "max", "avg", "var")


def _moments(name: str, c: Column) -> list[Column]:
    """MOMENTS of the values that aren't null."""
    c = c.cast("double")
    return [f(c).alias(f"{name}_{m}") for m, f in zip(MOMENTS, (F.count, F.min, F.max, F.avg, F.var_pop), strict=True)]


def _stats(name: str, *parts: str, zeros: Column | None = None) -> dict[str, Column]:
    """min, max, avg and population std of the values of several moments, and of `zeros` noughts, together."""
    sets = [{m: F.col(f"{part}_{m}") for m in MOMENTS} for part in parts]
    if zeros is not None:
        nought = F.when(zeros > 0, F.lit(0.0))
        sets.append({"n": zeros, "min": nought, "max": nought, "avg": nought, "var": nought})
    pick = lambda f, m: f(*[s[m] for s in sets]) if len(sets) > 1 else sets[0][m]
    weigh = lambda g: sum((F.coalesce(s["n"] * g(s), F.lit(0.0)) for s in sets[1:]), F.coalesce(sets[0]["n"] * g(sets[0]), F.lit(0.0)))
    n = F.nullif(weigh(lambda s: F.lit(1.0)), F.lit(0.0))
    avg = weigh(lambda s: s["avg"]) / n
    std = F.sqrt(weigh(lambda s: s["var"] + (s["avg"] - avg) * (s["avg"] - avg)) / n)
    return {f"{name}_min": pick(F.least, "min"), f"{name}_max": pick(F.greatest, "max"), f"{name}_avg": avg, f"{name}_std": std}


def matrix_features(a: SparseFrame, window: int = 1, max_gap: int = 0) -> DataFrame:
    """One wide row: dimensions, density, footprint, and min, max, avg and population std of every feature.

    What a row's entries say comes from one walk along the rows and one aggregate; empty rows and
    columns, and the steps from row to row, come in as moments of their own. What a matrix without
    entries has no mean of is null."""
    c = F.col
    ends, width = _ends_run(max_gap), c("last_col") - c("first_col")
    entries = walk(a, window, max_gap).agg(
        *_moments("num_neigh", c("neighbours")), *_moments("_step", c("after")), *_moments("group_sizes", F.when(ends, c("at") - c("start") + 1)),
        *_moments("_leap", F.when(ends, c("after"))), *_moments("_groups", F.when(c("after").isNull(), c("run"))),
    )
    rows = row_tails(a).agg(
        *_moments("_degree", c("degree")), *_moments("_bw", width / a.n), *_moments("_sc", F.when(width > 0, c("degree") / width).otherwise(F.lit(0.0))), *_moments("_tail", c("tail")),
        F.coalesce(F.sum("degree"), F.lit(0)).alias("nnz"),
    )
    cols = a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("degree")).agg(*_moments("_in", c("degree")))
    wide = entries.crossJoin(rows).crossJoin(cols).crossJoin(cross_row_similarity(a, window))  # one row each
    no_row, no_col = F.lit(a.m) - c("_degree_n"), F.lit(a.n) - c("_in_n")
    stats = {
        **_stats("nnz_per_row", "_degree", zeros=no_row), **_stats("bw_scaled", "_bw", zeros=no_row), **_stats("sc", "_sc", zeros=no_row), **_stats("nnz_per_col", "_in", zeros=no_col),
        **_stats("num_neigh", "num_neigh"), **_stats("nnz_col_dist", "_step", "_tail"), **_stats("group_sizes", "group_sizes"), **_stats("group_col_dist", "_leap", "_tail"),
        **_stats("groups_per_row", "_groups", zeros=no_row),
    }
    some = lambda x: F.nullif(c(x), F.lit(0.0))
    told = wide.select("nnz", "cross_row_similarity", c("group_sizes_n").alias("num_groups"), *[v.alias(k) for k, v in stats.items()])
    return told.withColumns({
        "m": F.lit(a.m).cast("long"), "n": F.lit(a.n).cast("long"), "density": c("nnz") * 100.0 / (float(a.m) * a.n), "mem_footprint": (c("nnz") * 12 + (a.m + 1) * 4) / MB,
        "skew": (c("nnz_per_row_max") - c("nnz_per_row_avg")) / some("nnz_per_row_avg"), "nnz_per_cluster": c("nnz_per_row_avg") / some("groups_per_row_avg"),
    })


VALIDATION = ("mem_footprint", "m", "n", "nnz", "sparsity", "nnz_per_row_avg", "nnz_per_row_std", "bw_scaled_avg", "skew", "num_neigh_avg", "cross_row_similarity")


def validation_line(a: SparseFrame, window: int = 1) -> DataFrame:
    """One row of VALIDATION."""
    c = F.col
    spans = row_spans(a).agg(F.sum("degree").alias("nnz"), F.avg("degree").alias("nnz_per_row_avg"), F.stddev_pop("degree").alias("nnz_per_row_std"), F.avg(c("bandwidth") / a.n).alias("bw_scaled_avg"), F.max("degree").alias("_most"))
    wide = spans.crossJoin(row_neighbours(a, window).agg(F.avg("neighbours").alias("num_neigh_avg"))).crossJoin(cross_row_similarity(a, window))
    return wide.withColumns({
        "m": F.lit(a.m).cast("long"), "n": F.lit(a.n).cast("long"), "sparsity": 1 - c("nnz") / (float(a.m) * a.n), "mem_footprint": (c("nnz") * 12 + (a.m + 1) * 4) / MB,
        "skew": (c("_most") - c("nnz_per_row_avg")) / F.nullif("nnz_per_row_avg", F.lit(0.0)),
    }).select(*VALIDATION)


def nnz_batches(a: SparseFrame, size: int) -> DataFrame:
    """batch, first_col, last_col, width_kb, distinct_cols: consecutive entries in row-major order, `size` at a time."""
    placed = scan.prefix_count(a.entries.select("row", "col"), scan.id_bucket("row"), ["row", "col"], "_at")
    own = placed.groupBy(F.floor(F.col("_at") / size).alias("batch")).agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count_distinct("col").alias("distinct_cols"))
    return own.select("batch", "first_col", "last_col", ((F.col("last_col") - F.col("first_col")) * 8 / 1024.0).alias("width_kb"), "distinct_cols")


def degree_histogram(a: SparseFrame, cumulative: bool = False) -> DataFrame:
    return hist.integer_histogram(row_degrees(a), "degree", cumulative=cumulative)


def neighbour_histogram(a: SparseFrame, window: int = 1) -> DataFrame:
    """Over all entries."""
    return hist.integer_histogram(row_neighbours(a, window), "neighbours")


def cross_row_histogram(a: SparseFrame, window: int = 1) -> DataFrame:
    counts = a.rows().join(cross_row_matches(a, window), "row", "left").select(F.coalesce("matches", F.lit(0)).alias("matches"))
    return hist.integer_histogram(counts, "matches")


def bandwidth_histogram(a: SparseFrame, bins: int) -> DataFrame:
    return hist.histogram(row_spans(a), "bandwidth", bins)


def density_map(a: SparseFrame, x_pixels: int, y_pixels: int, flip: bool = False) -> DataFrame:
    """y, x, count: entries on a grid of pixels, as hist.grid() rounds; flip turns the rows over."""
    return hist.grid(a.entries, "col", "row", (0, a.n - 1), (0, a.m - 1), x_pixels, y_pixels, flip)


def pixel_grid(m: int, n: int, most: int = 1024, most_ratio: int = 16) -> tuple[int, int]:
    """Pixels in x and y that keep the aspect, up to a ratio."""
    ratio = max(1 / most_ratio, min(most_ratio, n / m))
    x, y = (most, round(most / ratio)) if ratio >= 1 else (round(most * ratio), most)
    return min(x, n), min(y, m)
