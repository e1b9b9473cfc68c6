"""The catalogue: each operator on matrices made of the driver's tables, and the same in DuckDB's SQL.

A: order lines, orders by parts, with repeated cells and empty rows. E: users by vectors, from events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions import bits as B
from matrixloom.functions import metrics as M
from matrixloom.functions import text as T
from matrixloom.model import DenseFrame, SparseFrame
from matrixloom.operators import cluster, convert, features, hist, matmul, scan, values
from matrixloom.plans import planner, report
from matrixloom.sources import benchlog, files, mtx

QUERIES: dict = {}
SQL: dict[str, str] = {}
Frame = DataFrame


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def matrix_a(spark: SparkSession, d: str) -> SparseFrame:
    m, n = table(spark, d, "orders").count(), table(spark, d, "part").count()
    return SparseFrame.of(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", m, n)


def matrix_s(spark: SparkSession, d: str) -> SparseFrame:
    m, n = table(spark, d, "supplier").count(), table(spark, d, "part").count()
    return convert.dedupe_sum(SparseFrame.of(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", m, n))


def matrix_e(spark: SparkSession, d: str, n: int) -> SparseFrame:
    return SparseFrame.of(table(spark, d, "events"), "user_id", F.col("event_id") % n, F.lit(1.0), 1 << 20, n)


def part_k2(spark: SparkSession, d: str) -> DenseFrame:
    return DenseFrame.of(table(spark, d, "part"), "p_partkey", "p_size", F.lit(1))


def fixed_vectors(spark: SparkSession, d: str) -> DenseFrame:
    """All embeddings in whole ten-thousandths, so that sums don't depend on their order."""
    v = table(spark, d, "embeddings")
    return DenseFrame(v.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("double")).alias("vec")), 64)


def scratch(spark: SparkSession) -> str:
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints').rstrip('/')}/{uuid.uuid4().hex}"


A = 'a as (select l_orderkey "row", l_partkey col, l_quantity val from lineitem)'
S = 's as (select l_suppkey "row", l_partkey col, sum(l_quantity) val from lineitem group by all)'
R = 'r as (select unnest(range((select count(*) from orders))) "row")'
C = "c as (select unnest(range((select count(*) from part))) col)"
DEG = 'deg as (select r."row", count(a.col) degree, coalesce(max(a.col) - min(a.col), 0) bandwidth from r left join a using ("row") group by all)'


# -- products -----------------------------------------------------------------------------------


@query('select l_orderkey "row", sum(l_quantity * p_size) y0, sum(l_quantity) y1 from lineitem join part on l_partkey = p_partkey group by 1')
def spmm_part_k2(spark, d) -> Frame:
    return matmul.vec_columns(matmul.spmm(matrix_a(spark, d), part_k2(spark, d)), 2)


@query(f'with {R} select "row", coalesce(sum(l_quantity * p_size), 0) y0, coalesce(sum(l_quantity * 1), 0) y1 from r left join (lineitem join part on l_partkey = p_partkey) on l_orderkey = "row" group by 1')
def spmm_full_rows(spark, d) -> Frame:
    return matmul.vec_columns(matmul.spmm(matrix_a(spark, d), part_k2(spark, d), full_rows=True), 2)


@query('select l_orderkey "row", sum(l_quantity * p_size) y from lineitem join part on l_partkey = p_partkey group by 1')
def spmv_part(spark, d) -> Frame:
    return matmul.spmv(matrix_a(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x")))


@query('with x as (select vec_id, unnest(embedding) e, unnest(range(64)) c from embeddings), t as (select count(*) n from embeddings) select user_id "row", c::int c, sum(floor(e::double * 10000)) y from events cross join t join x on vec_id = event_id % n group by all')
def spmm_embedding_all(spark, d) -> Frame:
    n = table(spark, d, "embeddings").count()
    return matmul.spmm(matrix_e(spark, d, n), fixed_vectors(spark, d), dense_rows=n).select("row", F.posexplode("vec").alias("c", "y"))


@query('with x as (select vec_id, list_transform(embedding, lambda e: floor(e::double * 10000)) v from embeddings), t as (select count(*) n from embeddings) select user_id "row", event_id % n col, list_dot_product(u.v, w.v) val from events cross join t join x u on u.vec_id = user_id % n join x w on w.vec_id = event_id % n')
def sddmm_embedding_all(spark, d) -> Frame:
    n = table(spark, d, "embeddings").count()
    e, x = matrix_e(spark, d, n), fixed_vectors(spark, d)
    users = e.entries.select("row").distinct()
    u = DenseFrame(users.join(x.data, F.col("row") % n == x.data["id"]).select(F.col("row").alias("id"), "vec"), 64)
    return matmul.sddmm(e, u, x, v_rows=n)


@query('select l_orderkey "row", l_partkey col, l_quantity * (o_custkey % 7 * p_size + 1) val from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey')
def sddmm_scaled(spark, d) -> Frame:
    u = DenseFrame.of(table(spark, d, "orders"), "o_orderkey", F.col("o_custkey") % 7, F.lit(1))
    return matmul.sddmm(matrix_a(spark, d), u, part_k2(spark, d), scale=True)


@query('with g as (select l_orderkey "row", sum(l_quantity * p_size) y from lineitem join part on l_partkey = p_partkey group by 1) select round(max(abs(y - floor(y * 1.01)) / abs(y)), 9) max_rel_err from g where abs(y) > 1e-10')
def accuracy_max_rel_err(spark, d) -> Frame:
    gold = spmm_part_k2(spark, d).select("row", F.col("y0").alias("val"))
    test = gold.withColumn("val", F.floor(F.col("val") * 1.01).cast("double"))
    return matmul.max_relative_error(gold, test, ["row"]).select(F.round("max_rel_err", 9).alias("max_rel_err"))


@query(SQL["spmm_part_k2"])
def kahan_spmm(spark, d) -> Frame:
    return matmul.vec_columns(matmul.spmm_kahan(matrix_a(spark, d), part_k2(spark, d)), 2)


@query('with g as (select l_orderkey "row", sum(l_quantity * p_size) y from lineitem join part on l_partkey = p_partkey group by 1) select sum(power(y - floor(y / 2), 2)) squared_difference from g')
def squared_difference(spark, d) -> Frame:
    gold = spmm_part_k2(spark, d).select("row", F.col("y0").alias("val"))
    return matmul.squared_difference(gold, gold.withColumn("val", F.floor(F.col("val") / 2).cast("double")), ["row"])


@query('with n as (select s_nationkey "row", count(*) c from supplier group by 1) select "row", c from n where (select count(*) from n) > 20')
def size_gate(spark, d) -> Frame:
    return matmul.enough(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("row")).agg(F.count(F.lit(1)).alias("c")), 20)


@query('select l_suppkey "row", sum(l_quantity) total from lineitem group by 1')
def salted_heavy_rows(spark, d) -> Frame:
    return planner.salted_sum(matrix_s(spark, d).entries, ["row"], F.xxhash64("col"), 16, total=F.col("val"))


# -- conversions --------------------------------------------------------------------------------


@query('select l_partkey "row", l_orderkey col, l_quantity val from lineitem')
def transpose(spark, d) -> Frame:
    return convert.transpose(matrix_a(spark, d)).entries


@query(f'with {S} select "row", col, val from s where "row" >= col')
def lower_triangle(spark, d) -> Frame:
    return convert.lower_triangle(matrix_s(spark, d)).entries


@query(f'with {S} select "row", col, val from s union all select col, "row", -val from s where "row" != col')
def symmetrise_skew(spark, d) -> Frame:
    return convert.expand_symmetry(matrix_s(spark, d), skew=True).entries


@query(f'with {S}, l as (from s where "row" >= col) select "row", col, val from l union all select col, "row", val from l where "row" != col')
def symmetrise(spark, d) -> Frame:
    return convert.expand_lower(convert.lower_triangle(matrix_s(spark, d))).entries


@query('select l_orderkey "row", l_partkey col, sum(l_quantity) val from lineitem group by all')
def dedupe_sum(spark, d) -> Frame:
    return convert.dedupe_sum(matrix_a(spark, d)).entries


@query('select l_orderkey "row", l_partkey col, 1.0::double val from lineitem')
def set_ones(spark, d) -> Frame:
    return convert.set_ones(matrix_a(spark, d)).entries


@query('select (select count(*) from orders) - 1 - l_orderkey "row", l_partkey col, l_quantity val from lineitem')
def reorder_rows(spark, d) -> Frame:
    a = matrix_a(spark, d)
    return convert.reorder_rows(a, spark.range(a.m).select(F.col("id").alias("old"), (F.lit(a.m - 1) - F.col("id")).alias("new"))).entries


@query('select l_orderkey "row", l_partkey // 16 "window", count(*) "count" from lineitem group by all')
def quantize_columns(spark, d) -> Frame:
    return convert.quantize_columns(matrix_a(spark, d), 16)


@query('select l_orderkey "row", l_partkey col, l_quantity val from lineitem')
def pack_unpack(spark, d) -> Frame:
    a = matrix_a(spark, d)
    return convert.unpack_rows(convert.pack_rows(a), a.m, a.n).entries


@query(f'with {A}, {R}, {DEG} select "row", degree, coalesce(sum(degree) over (order by "row" rows between unbounded preceding and 1 preceding), 0)::bigint start from deg')
def prefix_scan_exclusive(spark, d) -> Frame:
    return convert.row_pointers(matrix_a(spark, d))


@query(f'with {A}, {R}, {DEG} select "row", degree, row_number() over (order by degree desc, "row") - 1 "rank" from deg')
def row_swizzle(spark, d) -> Frame:
    return convert.row_swizzle(matrix_a(spark, d))


@query(f'with {A}, {R}, {DEG}, k as (select "row", degree, row_number() over (order by degree desc, "row") - 1 rk, (select count(*) from orders) m from deg) select "row", degree, rk "rank", case when rk < (m + 3) // 4 then rk * 4 else (m - 1 - rk) // 3 * 4 + 1 + (m - 1 - rk) % 3 end slot from k')
def head_tail_interleave(spark, d) -> Frame:
    a = matrix_a(spark, d)
    return convert.head_tail_interleave(convert.row_swizzle(a), a.m, 4)


CHUNKS = 'k as (select "row", (row_number() over (partition by "row" order by col, val) - 1) // 3 chunk from a), e as (select "row", chunk, count(*) entries from k group by all)'


@query(f'with {A}, {R}, {CHUNKS} select "row", coalesce(chunk, 0) chunk, coalesce(entries, 0) entries from r left join e using ("row")')
def row_chunks(spark, d) -> Frame:
    return convert.row_chunks(matrix_a(spark, d), 3)


@query(f"with {A}, {CHUNKS} select \"row\", chunk, entries, case when entries >= 2 then 'segment' else 'residue' end kind from e")
def segments_and_residue(spark, d) -> Frame:
    return convert.segments_and_residue(matrix_a(spark, d), 3, 2)


@query(f'with {A}, {R}, {DEG} select "row", degree, floor(coalesce(sum(degree + 2.0) over (order by "row" rows between unbounded preceding and 1 preceding), 0) / 64)::bigint work_group from deg')
def cost_groups(spark, d) -> Frame:
    return convert.cost_groups(matrix_a(spark, d), 64, 2.0)


@query("select l_orderkey // 16 \"window\", count(distinct l_partkey) columns, ceil(count(distinct l_partkey) / 8)::bigint tiles from lineitem group by 1")
def condense_windows(spark, d) -> Frame:
    return convert.condense_windows(matrix_a(spark, d), 16, 8)


@query('select l_orderkey // 16 "window", l_orderkey "row", l_partkey col, dense_rank() over (partition by l_orderkey // 16 order by l_partkey) - 1 slot from lineitem')
def condensed_entries(spark, d) -> Frame:
    return convert.condensed_entries(matrix_a(spark, d), 16).withColumn("slot", F.col("slot").cast("long"))


@query('select l_suppkey // 8 panel, l_partkey col, count(*) entries, count(*) >= 3 dense from (select distinct l_suppkey, l_partkey from lineitem) group by all')
def panel_tiles(spark, d) -> Frame:
    return convert.panel_tiles(matrix_s(spark, d), 8, 3)


# -- structure ----------------------------------------------------------------------------------


@query(f'with {A}, {R}, {DEG} select "row", degree from deg')
def row_degrees(spark, d) -> Frame:
    return features.row_degrees(matrix_a(spark, d))


@query(f"with {A}, {C} select c.col, count(a.val) degree from c left join a using (col) group by all")
def col_degrees(spark, d) -> Frame:
    return features.col_degrees(matrix_a(spark, d))


@query(f'with {A}, {R}, {DEG} select "row", degree, bandwidth, case when bandwidth > 0 then degree / bandwidth else 0 end::double scatter from deg')
def bandwidth_scatter(spark, d) -> Frame:
    return features.row_spans(matrix_a(spark, d))


@query(f'with {A} select "row", col, count(*) over (partition by "row" order by col range between 20 preceding and 20 following) - 1 neighbours from a')
def row_neighbours(spark, d) -> Frame:
    return features.row_neighbours(matrix_a(spark, d), 20)


NEXT = 'f as (select "row", count(*) degree, min(col) c0 from a group by 1), nx as (select *, lead("row") over (order by "row") nr, lead(c0) over (order by "row") nc from f)'
MATCH = 'h as (select a."row", count(*) matches from a join nx using ("row") where exists (select 1 from a b where b."row" = nx.nr and abs(a.col - b.col) <= 8) group by 1), mt as (select "row", degree, coalesce(matches, 0) matches from nx left join h using ("row"))'


@query(f'with {A}, {NEXT}, {MATCH} select "row", degree, matches from mt')
def cross_row_matches(spark, d) -> Frame:
    return features.cross_row_matches(matrix_a(spark, d), 8)


@query(f"with {A}, {NEXT}, {MATCH} select round(avg(matches / degree), 9) cross_row_similarity from mt")
def cross_row_similarity(spark, d) -> Frame:
    return features.cross_row_similarity(matrix_a(spark, d), 8).select(F.round("cross_row_similarity", 9).alias("cross_row_similarity"))


DIST = 'ds as (select "row", col, coalesce(abs(lead(col) over (order by "row", col) - col), 0) distance from a)'


@query(f'with {A}, {DIST} select "row", col, distance from ds')
def nnz_col_distances(spark, d) -> Frame:
    return features.column_distances(matrix_a(spark, d))


GROUPS = (
    'ga as (select "row", col, coalesce(abs(lead(col) over (order by "row", col) - col), 0) distance, case when col - lag(col) over (partition by "row" order by col) <= GAP then 0 else 1 end nw, '
    'row_number() over (partition by "row" order by col) rn from a), gb as (select *, sum(nw) over (partition by "row" order by col, rn rows unbounded preceding) g from ga), '
    'gr as (select "row", g::bigint "group", count(*) size, arg_max(distance, rn) distance from gb group by all)'
)


@query(f'with {A}, {GROUPS.replace("GAP", "40")} select "row", "group", size, distance from gr')
def column_groups(spark, d) -> Frame:
    return features.column_groups(matrix_a(spark, d), 39)


@query(f'with {A}, {R}, {GROUPS.replace("GAP", "40")} select r."row", count("group") "groups" from r left join gr using ("row") group by all')
def groups_per_row(spark, d) -> Frame:
    return features.groups_per_row(matrix_a(spark, d), 39)


@query(f'with {A}, g as (select col - lag(col) over w b, lead(col) over w - col f from a window w as (partition by "row" order by col)) select count(*) filter (coalesce(b > 31, true) and coalesce(f > 31, true)) distant from g')
def distant_nonzeros(spark, d) -> Frame:
    return features.distant_nonzeros(matrix_a(spark, d), 30)


@query(f"with {A}, {R}, {DEG} select count(*) filter (degree < 3) \"rows\", coalesce(sum(degree) filter (degree < 3), 0)::bigint nnz, count(*) filter (degree < 3) * 100.0::double / count(*) rows_percent, coalesce(sum(degree) filter (degree < 3), 0) * 100.0::double / sum(degree) nnz_percent from deg")
def short_rows(spark, d) -> Frame:
    return features.short_rows(matrix_a(spark, d), 3)


@query(f"with {A}, {R}, {DEG}, t as (select sum(degree) z, count(*) m, coalesce(sum(degree) filter (degree < 3), 0) sz, count(*) filter (degree < 3) sm from deg) select ((z * 12 + (m + 1) * 4) / 1048576)::double mb, ((sz * 12 + (sm + 1) * 4) / 1048576)::double short_mb, (((z - sz) * 12 + (m - sm + 1) * 4) / 1048576)::double long_mb from t")
def row_footprints(spark, d) -> Frame:
    return features.row_footprints(matrix_a(spark, d), 3)


def _stat(name: str, x: str) -> str:
    return ", ".join(f"round({f}({x}), 6)::double {name}_{s}" for f, s in (("min", "min"), ("max", "max"), ("avg", "avg"), ("stddev_pop", "std")))


FEATURE_SQL = (
    f"with {A}, {R}, {C}, {DEG}, {NEXT}, {MATCH.replace('<= 8', '<= 1')}, {DIST}, {GROUPS.replace('GAP', '1')}, "
    'cd as (select c.col, count(a.val) degree from c left join a using (col) group by all), '
    'nb as (select count(*) over (partition by "row" order by col range between 1 preceding and 1 following) - 1 k from a), '
    'gp as (select r."row", count("group") k from r left join gr using ("row") group by all), '
    f"t1 as (select {_stat('nnz_per_row', 'degree')}, {_stat('bw_scaled', 'bandwidth / (select count(*) from part)')}, {_stat('sc', 'case when bandwidth > 0 then degree / bandwidth else 0 end')}, sum(degree)::bigint nnz, max(degree) mx, avg(degree) av from deg), "
    f"t2 as (select {_stat('nnz_per_col', 'degree')} from cd), t3 as (select {_stat('num_neigh', 'k')} from nb), t4 as (select {_stat('nnz_col_dist', 'distance')} from ds), "
    f"t5 as (select {_stat('group_sizes', 'size')}, {_stat('group_col_dist', 'distance')}, count(*) num_groups from gr), t6 as (select {_stat('groups_per_row', 'k')}, avg(k) gav from gp), t7 as (select round(avg(matches / degree), 6) cross_row_similarity from mt) "
    "select * exclude (mx, av, gav), (select count(*) from orders) m, (select count(*) from part) n, round(nnz * 100.0::double / ((select count(*) from orders)::double * (select count(*) from part)), 6) density, "
    "round(((nnz * 12 + ((select count(*) from orders) + 1) * 4) / 1048576)::double, 6) mem_footprint, round((mx - av) / av, 6) skew, round(av / gav, 6) nnz_per_cluster from t1, t2, t3, t4, t5, t6, t7"
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(FEATURE_SQL)
def matrix_features(spark, d) -> Frame:
    return rounded(features.matrix_features(matrix_a(spark, d)))


@query(f"select mem_footprint, m, n, nnz, round(1 - nnz / (m::double * n), 6) sparsity, nnz_per_row_avg, nnz_per_row_std, bw_scaled_avg, skew, num_neigh_avg, cross_row_similarity from ({FEATURE_SQL})")
def validation_line(spark, d) -> Frame:
    return rounded(features.validation_line(matrix_a(spark, d)))


def _hist(source: str, column: str) -> str:
    return f"hb as (select {column} x, count(*) n from {source} group by 1), hx as (select unnest(range((select min(x) from hb), (select max(x) from hb) + 1)) x), hh as (select hx.x, coalesce(n, 0) n from hx left join hb using (x))"


@query(f'with {A}, {R}, {DEG}, {_hist("deg", "degree")} select x, n "count", round(n * 100.0::double / sum(n) over (), 9) percent from hh')
def degree_histogram(spark, d) -> Frame:
    return rounded(features.degree_histogram(matrix_a(spark, d)), 9)


@query(f'with {A}, {R}, {DEG}, {_hist("deg", "degree")} select x, (sum(n) over (order by x))::bigint "count", round(sum(n) over (order by x) * 100.0::double / sum(n) over (), 9) percent from hh')
def degree_histogram_cumulative(spark, d) -> Frame:
    return rounded(features.degree_histogram(matrix_a(spark, d), cumulative=True), 9)


@query(f'with {A}, nb as (select count(*) over (partition by "row" order by col range between 5 preceding and 5 following) - 1 k from a), {_hist("nb", "k")} select x, n "count", round(n * 100.0::double / sum(n) over (), 9) percent from hh')
def neighbour_histogram(spark, d) -> Frame:
    return rounded(features.neighbour_histogram(matrix_a(spark, d), 5), 9)


@query(f'with {A}, {R}, {NEXT}, {MATCH}, ma as (select coalesce(matches, 0) k from r left join mt using ("row")), {_hist("ma", "k")} select x, n "count", round(n * 100.0::double / sum(n) over (), 9) percent from hh')
def cross_row_histogram(spark, d) -> Frame:
    return rounded(features.cross_row_histogram(matrix_a(spark, d), 8), 9)


@query(f'with {A}, {R}, {DEG}, e as (select min(bandwidth)::double lo, (max(bandwidth) - min(bandwidth))::double / 20 w from deg), h as (select least(floor((bandwidth - lo) / w), 19)::int b, count(*) n from deg, e group by 1), f as (select unnest(range(20)) b) select round(lo + f.b * w, 9) x, coalesce(n, 0) "count", round(coalesce(n, 0) * 100.0::double / (sum(coalesce(n, 0)) over ()), 9) percent from f cross join e left join h using (b)')
def bandwidth_histogram(spark, d) -> Frame:
    return rounded(features.bandwidth_histogram(matrix_a(spark, d), 20), 9)


@query('select floor(l_orderkey / (((select count(*) from orders) - 1) / 63) + 0.5)::bigint y_pix, floor(l_partkey / (((select count(*) from part) - 1) / 63) + 0.5)::bigint x_pix, count(*) "count" from lineitem group by all')
def density_map(spark, d) -> Frame:
    return features.density_map(matrix_a(spark, d), 64, 64)


@query(f'with {A}, b as (select (row_number() over (order by "row", col) - 1) // 1000 batch, col from a) select batch, min(col) first_col, max(col) last_col, ((max(col) - min(col)) * 8 / 1024)::double width_kb, count(distinct col) distinct_cols from b group by 1')
def nnz_batches(spark, d) -> Frame:
    return features.nnz_batches(matrix_a(spark, d), 1000)


@query(f'with {A}, {R}, {DEG}, p as (select "row", degree, coalesce(sum(degree) over (order by "row" rows between unbounded preceding and 1 preceding), 0)::double b, (sum(degree) over ())::double t from deg) select "row", degree, least(floor(b * 24 / t), 23)::bigint part from p')
def nnz_balanced_partitions(spark, d) -> Frame:
    return scan.balanced_parts(features.row_degrees(matrix_a(spark, d)), scan.id_bucket("row"), ["row"], "degree", 24)


@query('select o_orderkey "row", (ntile(24) over (order by o_orderkey) - 1)::bigint part from orders')
def even_partitions(spark, d) -> Frame:
    return scan.even_parts(table(spark, d, "orders").select(F.col("o_orderkey").alias("row")), scan.id_bucket("row"), ["row"], 24)


@query('with e as (select min(p_retailprice) lo, max(p_retailprice) hi from part), s as (select least(floor((p_retailprice - lo) * 10 / (hi - lo)), 9)::bigint slice, p_size from part, e) select slice, min(p_size) "min", max(p_size) "max", round(avg(p_size), 9) "avg", quantile_cont(p_size, 0.25)::double q25, quantile_cont(p_size, 0.5)::double q50, quantile_cont(p_size, 0.75)::double q75 from s group by 1')
def bounded_median(spark, d) -> Frame:
    return rounded(hist.bounded_median(table(spark, d, "part"), "p_retailprice", "p_size", 10), 9)


@query('select o_orderkey i, o_custkey v, (sum(o_custkey) over (order by o_orderkey))::bigint forward, (sum(o_custkey) over (order by o_orderkey desc) - o_custkey)::bigint backward from orders')
def prefix_scans(spark, d) -> Frame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    both = scan.prefix_sum(o, scan.id_bucket("i"), ["i"], "v", "forward", exclusive=False)
    return scan.prefix_sum(both, scan.id_bucket("i"), ["i"], "v", "backward", backward=True)


@query('select c_custkey i, c_acctbal v, (select max(s_acctbal) from supplier where s_acctbal <= c_acctbal) below from customer')
def as_of_lookup(spark, d) -> Frame:
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    return scan.as_of(left, table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), "v", "below")


@query('select o_orderkey i, o_orderpriority k, row_number() over (order by o_orderpriority, o_orderkey) - 1 place from orders')
def bucket_sort(spark, d) -> Frame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("k"))
    return scan.bucket_sort(o, "k", ["i"])


@query("select n_nationkey i, list_reduce(list_prepend(0::bigint, list_transform(range(1, length(n_name) + 1), lambda k: ascii(n_name[k])::bigint)), lambda h, c: (h * 31 + c) % 4294967296) h from nation")
def kr_hash(spark, d) -> Frame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), T.kr_hash("n_name").alias("h"))


# -- metrics ------------------------------------------------------------------------------------


def numbers(spark, d) -> DataFrame:
    """i, v (actual), f (forecast): supplier balances and a rounding of them; small, so that float sums agree."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"), (F.floor(F.col("s_acctbal") / 10) * 10.0 + 1).alias("f"))


N = "n as (select s_suppkey i, s_acctbal v, floor(s_acctbal / 10) * 10.0::double + 1 f from supplier)"


@query(f"with {N} select round(sum(abs(v)), 4) p1, round(sqrt(sum(v * v)), 4) p2, round(power(sum(power(abs(v), 3)), 1 / 3::double), 4) p3, count(*) filter (v > 1000) over_1000 from n")
def metric_norms(spark, d) -> Frame:
    return numbers(spark, d).agg(*[F.round(M.pnorm("v", p), 4).alias(f"p{p}") for p in (1, 2, 3)], M.count_over("v", 1000).alias("over_1000"))


@query(f"with {N} select round(avg(v), 6) mean, round(avg(abs(v)), 6) mean_abs, round(exp(avg(ln(abs(v)))), 6) geometric, round(1 / avg(1 / v), 6) harmonic, round(sqrt(avg(v * v)), 6) rms from n")
def metric_means(spark, d) -> Frame:
    return numbers(spark, d).agg(*[F.round(f("v"), 6).alias(k) for k, f in (("mean", M.mean), ("mean_abs", M.mean_abs), ("geometric", M.geometric_mean), ("harmonic", M.harmonic_mean), ("rms", M.rms))])


@query(f"with {N} select round(avg(v - 5), 6) m1, round(avg(power(v - 5, 2)), 3) m2, round(avg(power((v - 5) / 100, 3)), 6) z3 from n")
def metric_moments(spark, d) -> Frame:
    return numbers(spark, d).agg(F.round(M.moment("v", 1, 5), 6).alias("m1"), F.round(M.moment("v", 2, 5), 3).alias("m2"), F.round(M.standardized_moment("v", 3, 5, 100), 6).alias("z3"))


@query(f"with {N} select round(var_pop(v), 3) var, round(stddev_pop(v), 6) std, round(avg(power(v - (select avg(v) from n), 2)), 3) var_about, round(avg(abs(v - (select avg(v) from n))), 6) mad from n")
def metric_dispersion(spark, d) -> Frame:
    n = numbers(spark, d)
    both = n.crossJoin(F.broadcast(n.agg(F.avg("v").alias("mu"))))
    return both.agg(F.round(M.variance("v"), 3).alias("var"), F.round(M.std("v"), 6).alias("std"), F.round(M.variance_about("v", F.col("mu")), 3).alias("var_about"), F.round(M.mean_absolute_deviation("v", F.col("mu")), 6).alias("mad"))


QS = (0.1, 0.25, 0.5, 0.9)
_H = {"linear": "(n - 1) * q", "hazen": "n * q - 0.5", "weibull": "(n + 1) * q - 1", "median_unbiased": "(n + 1 / 3) * q - 2 / 3", "normal_unbiased": "(n + 1 / 4) * q - 5 / 8", "interpolated_inverted_cdf": "n * q - 1"}


@query("with l as (select list_sort(list(s_acctbal)) x, count(*)::double n from supplier), q as (select unnest([0.1, 0.25, 0.5, 0.9])::double q), h as (" + " union all ".join(f"select '{k}' \"method\", q, x, n, least(greatest({h}, 0), n - 1) h from l, q" for k, h in _H.items()) + ") select \"method\", q, round(x[floor(h)::bigint + 1] + (h - floor(h)) * (x[least(floor(h) + 2, n)::bigint] - x[floor(h)::bigint + 1]), 6) \"value\" from h")
def metric_quantiles(spark, d) -> Frame:
    n = numbers(spark, d)
    return rounded(matmul.union_all([M.quantiles(n, "v", list(QS), k).withColumn("method", F.lit(k)) for k in _H]))


@query("with l as (select list_sort(list(s_acctbal)) x, count(*)::double n from supplier), q as (select unnest([0.1, 0.25, 0.5, 0.9])::double q) select q, round(x[greatest(ceil(n * q - 1e-12), 1)::bigint], 6) \"value\" from l, q")
def metric_quantiles_discrete(spark, d) -> Frame:
    return rounded(M.quantiles(numbers(spark, d), "v", list(QS), "inverted_cdf"))


@query(f"with {N} select round(avg(abs(v - f)), 6) mae, round(max(abs(v - f)), 6) max_abs, round(avg(power(v - f, 2)), 6) mse from n")
def metric_errors_abs(spark, d) -> Frame:
    return numbers(spark, d).agg(F.round(M.mae("v", "f"), 6).alias("mae"), F.round(M.max_abs_error("v", "f"), 6).alias("max_abs"), F.round(M.mse("v", "f"), 6).alias("mse"))


@query(f"with {N}, e as (select v, f, abs(v - f) x, 2.220446049250313e-16::double eps from n) select round(avg(x / greatest(abs(v), eps)), 9) mare, round(100 * avg(x / greatest(abs(v), eps)), 7) mape, round(avg(x / greatest(abs(v) + abs(f), eps)), 9) smare, round(100 * avg(x / greatest(abs(v) + abs(f), eps)), 7) smape, round(avg(case when x <= 2 * eps then 1 else abs(f / v) end), 9) q_error from e")
def metric_errors_rel(spark, d) -> Frame:
    return numbers(spark, d).agg(*[F.round(f("v", "f"), k).alias(n) for n, f, k in (("mare", M.mare, 9), ("mape", M.mape, 7), ("smare", M.smare, 9), ("smape", M.smape, 7), ("q_error", M.q_error, 9))])


@query(f"with {N}, e as (select v, f, 2.220446049250313e-16::double eps from n), l as (select avg(log10(greatest(abs(f), eps)) - log10(greatest(abs(v), eps))) q, avg(log10((abs(v - f) + eps) / (greatest(abs(v) + abs(f), eps) + eps))) s from e) select round(q, 9) ln_q_error, round(log10(abs(power(10, q) - 1)), 6) mlare, round(power(10, log10(abs(power(10, q) - 1))), 9) gmare, round(s, 6) smlare from l")
def metric_errors_log(spark, d) -> Frame:
    return numbers(spark, d).agg(*[F.round(f("v", "f"), k).alias(n) for n, f, k in (("ln_q_error", M.ln_q_error, 9), ("mlare", M.mlare, 6), ("gmare", M.gmare, 9), ("smlare", M.smlare, 6))])


@query("with o as (select o_orderkey i, o_custkey % 50 v from orders) select min(v) lo, max(v) hi, (select min(i) from o where v = (select min(v) from o)) at_lo, (select min(i) from o where v = (select max(v) from o)) at_hi from o")
def argmin_argmax(spark, d) -> Frame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 50).alias("v"))
    return o.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), M.arg_min("v", "i").alias("at_lo"), M.arg_max("v", "i").alias("at_hi"))


@query("select distinct l_quantity v, (select count(distinct l_quantity) from lineitem) n from lineitem")
def unique_values(spark, d) -> Frame:
    v = table(spark, d, "lineitem").select(F.col("l_quantity").alias("v"))
    return v.distinct().crossJoin(F.broadcast(v.agg(M.unique_num("v").alias("n"))))


@query("with w as (select o_orderkey // 100 w, max(o_totalprice) x from orders group by 1) select round(min(x), 6) \"value\" from w")
def windowed_aggregate(spark, d) -> Frame:
    return rounded(values.windowed_aggregate(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 100, F.max, F.min))


@query('with s as (select s_acctbal v, s_suppkey "left", lead(s_acctbal) over (order by s_acctbal, s_suppkey) - s_acctbal gap, lead(s_suppkey) over (order by s_acctbal, s_suppkey) "right" from supplier) select gap, "left", "right" from s where gap is not null order by gap, v, "left", "right" limit 1')
def closest_pair(spark, d) -> Frame:
    return values.closest_pair(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")


@query("with s as (select o_totalprice v, lag(o_totalprice) over (order by o_totalprice) p from orders) select v, round(coalesce(v - p, 0), 6) diff, round(case when p is not null and p != 0 then abs(v / p) else 0 end, 6) ratio, round(case when p is not null and p != 0 then abs((v - p) / p) else 0 end, 6) \"relative\" from s")
def sorted_value_diffs(spark, d) -> Frame:
    return values.sorted_differences(table(spark, d, "orders"), "o_totalprice").select("v", *[F.round(c, 6).alias(c) for c in ("diff", "ratio", "relative")])


#: In DuckDB: the bits u of a positive double v, and their trailing zeros.
U = "(v::double)::bit::bigint"
TZ = "(case when u = 0 then 64 else bit_count((u & -u) - 1) end)::bigint"


@query(f"with w as (select l_quantity v, floor(log2(l_quantity)) e, {U} u from (select l_quantity, l_quantity v from lineitem)), v as (select *, {TZ} tz from w) select round(avg(tz), 6) tz_avg, round(stddev_pop(tz), 6) tz_std, count(distinct u >> 52) unique_upper12, count(*) n, min(v) val_min, max(v) val_max, round(avg(v), 6) val_avg, round(stddev_pop(v), 6) val_std, min(abs(v)) abs_min, max(abs(v)) abs_max, round(avg(abs(v)), 6) abs_avg, round(stddev_pop(abs(v)), 6) abs_std, min(e) exponent_min, max(e) exponent_max, round(avg(e), 6) exponent_avg, round(stddev_pop(e), 6) exponent_std, count(distinct v) unique_values, round(count(distinct v) / count(*), 6) unique_fraction, length(bin(count(distinct v))) index_bits from v")
def value_summary(spark, d) -> Frame:
    return rounded(values.value_summary(table(spark, d, "lineitem"), "l_quantity"))


@query(f"with w as (select *, {U} u from (select o_orderkey, o_totalprice v from orders)), t as (select *, {TZ} tz from w) select o_orderkey, v, 0::bigint sign, case when u = 0 then 0 else (u >> 52) - 1023 end::bigint exponent, u & 4503599627370495 fraction, u >> 52 upper12, tz trailing_zeros, case when u = 0 then 64 else 64 - length(bin(u)) + tz end::bigint surrounding_zeros from t")
def double_bits(spark, d) -> Frame:
    return values.double_bits(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query(f"with w as (select *, {U} u from (select o_orderkey i, o_totalprice v from orders)), t as (select i // 64 blk, min({TZ}) least, count(*) n from w group by blk) select sum(least * n) / sum(n) mean_ctz_min from t")
def ctz_windows(spark, d) -> Frame:
    return values.ctz_windows(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 64)


@query()
def neighbour_bit_differences(spark, d) -> Frame:
    return values.neighbour_bit_differences(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query()
def sorted_subset_differences(spark, d) -> Frame:
    return values.sorted_subset_differences(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query()
def cluster_centre_distances(spark, d) -> Frame:
    return values.cluster_centre_distances(table(spark, d, "supplier"), "s_acctbal", 3)


@query("select sum(case when 2 * s >= n then 1::bigint << b else 0 end)::bigint majority from (select b, count(*) n, sum((o_custkey >> b) & 1) s from orders, (select unnest(range(20)) b) group by b)")
def bit_means(spark, d) -> Frame:
    return values.bit_means(table(spark, d, "orders"), "o_custkey", 20)


@query("select o_orderkey i, bit_count(o_custkey)::int ones, bit_count(xor(o_custkey, o_orderkey))::int distance, (o_custkey >> 3) & 15 mid, o_custkey | 7 low_set, o_custkey & ~7 low_unset, o_custkey - 4611686018427387904 high_set, o_custkey high_unset, case when o_custkey = 0 then 0 else length(bin(o_custkey)) end bit_length from orders")
def integer_bits(spark, d) -> Frame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("i"), F.bit_count(c).alias("ones"), B.hamming(c, k).alias("distance"), B.extract_range(c, 3, 4).alias("mid"), B.set_low(c, 3).alias("low_set"), B.unset_low(c, 3).alias("low_unset"), B.set_high(c, 2).alias("high_set"), B.unset_high(B.set_high(c, 2), 3).alias("high_unset"), B.bit_length(c).cast("long").alias("bit_length"))


@query()
def kmeans_iterations(spark, d) -> Frame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    centres = [r["vec"] for r in v.where("id < 4").orderBy("id").collect()]
    return cluster.kmeans(v, centres, "euclidean", 6)[1].select("id", "cluster")


@query()
def kmeans_binary(spark, d) -> Frame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bits"))
    return cluster.kmeans_binary(o, [0, 1023, 341], 20, 8)[1].select("id", "cluster")


# -- files --------------------------------------------------------------------------------------


@query('select l_orderkey "row", l_partkey col, l_quantity val from lineitem')
def mtx_roundtrip(spark, d) -> Frame:
    path = scratch(spark)
    mtx.write_mtx(matrix_a(spark, d), path, order=False)
    return mtx.read_mtx(spark, path)[1].entries


@query("select * from (values (0, 0), (0, 1), (0, 4), (2, 1), (2, 2), (2, 5), (3, 3)) t(\"row\", col) cross join (select 1.0::double val)")
def smtx_read(spark, d) -> Frame:
    path = scratch(spark)
    spark.createDataFrame([("4, 6, 7\n0 3 3 6 7\n0 1 4 1 2 5 3",)], "value string").coalesce(1).write.text(path)
    return files.read_smtx(spark, path).entries.select(F.col("row").cast("int"), F.col("col").cast("int"), "val")


@query("select * from (values (0, 1), (1, 2), (1, 0), (2, 1), (0, 0), (1, 1), (2, 2)) t(\"row\", col) cross join (select 1.0::double val)")
def openfoam_read(spark, d) -> Frame:
    path = scratch(spark)
    note = 'note "nPoints:8 nCells:3 nFaces:5 nInternalFaces:2";'
    for name, v in (("owner", "0\n1\n0\n1\n2"), ("neighbour", "1\n2")):
        spark.createDataFrame([(f"FoamFile\n{{\n{note}\n}}\n5\n(\n{v}\n)",)], "value string").coalesce(1).write.text(f"{path}/{name}")
    return files.read_openfoam(spark, f"{path}/owner", f"{path}/neighbour").entries.select(F.col("row").cast("int"), F.col("col").cast("int"), "val")


@query("select c_custkey i, c_name || '/x.' || c_mktsegment || '.mtx' path, c_name head, 'x.' || c_mktsegment || '.mtx' tail, '.mtx' ext, c_name || '/x.' || c_mktsegment stem, length(c_name)::int found from customer")
def path_functions(spark, d) -> Frame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.concat("c_name", F.lit("/x."), "c_mktsegment", F.lit(".mtx")).alias("path"))
    return c.select("i", "path", T.path_head("path").alias("head"), T.path_tail("path").alias("tail"), T.path_ext("path").alias("ext"), T.strip_ext("path").alias("stem"), T.find("path", "/x").alias("found"))


@query("select n_nationkey i, list_reduce(list_prepend(5381::bigint, list_transform(range(1, length(n_name) + 1), lambda k: ascii(n_name[k])::bigint)), lambda h, c: (h * 33 + c) % 4294967296) h from nation")
def djb2_hash(spark, d) -> Frame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), T.djb2("n_name").alias("h"))


@query("select word, count(*) n from (select unnest(regexp_split_to_array(p_name, '\\s+')) word from part) where word != '' group by 1")
def word_tokens(spark, d) -> Frame:
    return table(spark, d, "part").select(F.explode(T.words("p_name")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey old from orders")
def random_permutation(spark, d) -> Frame:
    n = table(spark, d, "orders").count()
    p = files.random_permutation(spark, n, 3)
    return p.select("new").withColumnRenamed("new", "old")


# -- runs ---------------------------------------------------------------------------------------

FORMATS = ["VENDOR_A", "TILED-1", "TILED-2", "PILOT-1", "PILOT-2", "WARP-4"]


def runs(spark, d) -> DataFrame:
    """Log lines made of order lines, printed and parsed again."""
    c = F.col
    # the driver's table is one row group, so one task reads it; logs come as many files
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity").repartition(spark.sparkContext.defaultParallelism)
    pid = c("l_partkey") % 12
    n = (1000 + 100 * pid).cast("long")
    name = F.concat(F.lit("./matrices/"), F.when(c("l_suppkey") % 2 == 0, "random_pruned_a").otherwise("window_mask_b"), F.lit("/m"), pid.cast("string"), F.lit(".mtx"))
    system = F.when(c("l_returnflag") == "A", "AMD-EPYC-24").otherwise("NVIDIA-A100")
    fmt = F.element_at(F.array(*[F.lit(x) for x in FORMATS]), (c("l_suppkey") % 6 + 1).cast("int"))
    k = F.expr("shiftleft(16, l_linenumber % 3)")
    nnz = F.floor(n * n * (pid + 1) / 26)
    z = F.lit(0.01)
    return benchlog.parse(li.select(benchlog.line(F.lit("SpMM"), name, n, n, nnz, z, z, z, fmt, k, system, c("l_quantity")).alias("value")), "./matrices/")


RUNS = (
    "ru as (select case when l_suppkey % 2 = 0 then 'random_pruned_a' else 'window_mask_b' end || '/m' || (l_partkey % 12) matrix, 1000 + 100 * (l_partkey % 12) \"rows\", 1000 + 100 * (l_partkey % 12) cols, "
    "((1000 + 100 * (l_partkey % 12)) * (1000 + 100 * (l_partkey % 12)) * (l_partkey % 12 + 1)) // 26 nnz, ['VENDOR_A', 'TILED-1', 'TILED-2', 'PILOT-1', 'PILOT-2', 'WARP-4'][l_suppkey % 6 + 1] format, "
    "(16 << (l_linenumber % 3))::int k, case when l_returnflag = 'A' then 'AMD-EPYC-24' else 'NVIDIA-A100' end system, l_quantity gflops from lineitem), "
    "av as (select matrix, format, system, k, any_value(\"rows\") \"rows\", any_value(cols) cols, any_value(nnz) nnz, avg(gflops) gflops, count(*) repeats from ru group by matrix, format, system, k), "
    "rv as (select *, round_even((8 * nnz + 4 * (\"rows\" + 1)) / 1048576, 4) mem_footprint, round_even((1 - nnz / (\"rows\"::double * cols)) * 100, 4) sparsity from av)"
)


def averages(spark, d) -> DataFrame:
    return report.runs_avg(runs(spark, d))


@query(f'with {RUNS} select matrix, "rows", cols, nnz, format, k, system, gflops from ru')
def parse_logs(spark, d) -> Frame:
    return runs(spark, d).select("matrix", "rows", "cols", "nnz", "format", "k", "system", "gflops")


@query(f"with {RUNS} select * replace (round(gflops, 6) as gflops) from rv")
def runs_avg(spark, d) -> Frame:
    return averages(spark, d).withColumn("gflops", F.round("gflops", 6))


@query(f"with {RUNS}, t as (select matrix, format, system, k, round_even(mem_footprint + 2.0::double * \"rows\" * k * 4 / 1048576, 0) mem_footprint_total from rv) select *, case when system like 'AMD%' then case when mem_footprint_total > 5 then '>LLC' else '<LLC' end else 'NULL' end LLC_split from t")
def footprint_llc_split(spark, d) -> Frame:
    both = report.with_llc_split(report.with_total_footprint(averages(spark, d)), F.col("system").startswith("AMD"), 5)
    return both.select("matrix", "format", "system", "k", "mem_footprint_total", "LLC_split")


@query(f"with {RUNS} select system, format, round_even(quantile_cont(gflops, 0.25), 2) q1, round_even(quantile_cont(gflops, 0.5), 2) median, round_even(quantile_cont(gflops, 0.75), 2) q3, round_even(max(gflops), 2) \"max\", count(*) n, count(distinct matrix) matrices from rv group by all")
def quartiles_by_group(spark, d) -> Frame:
    return report.quartiles(averages(spark, d), ["system", "format"])


@query(f"with {RUNS} select system, case when grouping(k) = 1 then null else k end k, round(quantile_cont(gflops, 0.25), 6) q1, round(quantile_cont(gflops, 0.5), 6) median, round(quantile_cont(gflops, 0.75), 6) q3, round(max(gflops), 6) \"max\", count(*) n, count(distinct matrix) matrices from rv group by grouping sets ((system), (system, k))")
def quartiles_with_split(spark, d) -> Frame:
    return rounded(report.quartiles_with_split(averages(spark, d), ["system"], "k"))


@query(f"with {RUNS}, q as (select format, quantile_cont(gflops, 0.25) q1, quantile_cont(gflops, 0.5) median, quantile_cont(gflops, 0.75) q3 from rv group by 1) select format, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3, round(min(gflops) filter (gflops between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) low, round(max(gflops) filter (gflops between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) high, count(*) filter (not gflops between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) fliers from rv join q using (format) group by all")
def boxplot_data(spark, d) -> Frame:
    return rounded(report.boxplot(averages(spark, d), ["format"]))


PIVOT = ["VENDOR_A_16", "VENDOR_A_32", "WARP-4_16"]


@query(f"with {RUNS}, x as (select * from rv where system = 'NVIDIA-A100') select matrix, " + ", ".join(f"round(max(gflops) filter (format || '_' || k = '{p}'), 6) \"{p}\"" for p in PIVOT) + " from x group by 1")
def pivot_gflops(spark, d) -> Frame:
    return rounded(report.pivot_gflops(averages(spark, d).where("system = 'NVIDIA-A100'"), PIVOT))


@query(f"with {RUNS} select matrix, format, system, k, unnest(['gflops', 'sparsity']) variable, unnest([round(gflops, 6), sparsity]) \"value\" from rv")
def melt_gflops(spark, d) -> Frame:
    return rounded(report.melt(averages(spark, d), ["matrix", "format", "system", "k"], ["gflops", "sparsity"]))


@query(f"with {RUNS}, o as (select matrix, k, arg_min(format, (-gflops, format)) format from rv where system = 'NVIDIA-A100' and format like '%TILED%' group by all) select format, count(*) filter (k = 16) k16, count(*) filter (k = 32) k32, count(*) filter (k = 64) k64 from o group by 1")
def best_version_votes(spark, d) -> Frame:
    return report.best_version_votes(averages(spark, d).where("system = 'NVIDIA-A100'"), "TILED", [16, 32, 64])


@query(f"with {RUNS} select matrix, format, system, k from rv where not (lower(format) like '%tiled%' and format != 'TILED-2') and not (lower(format) like '%pilot%' and format != 'PILOT-2')")
def drop_versions(spark, d) -> Frame:
    return report.drop_versions(averages(spark, d), {"tiled": "TILED-2", "pilot": "PILOT-2"}).select("matrix", "format", "system", "k")


LEVELS = " ".join(f"when sparsity >= {a} and sparsity < {b} then '[{50 if a == 30 else a}-{b})'" for a, b in zip(report.SPARSITY_EDGES, report.SPARSITY_EDGES[1:], strict=False))


@query(f"with {RUNS}, x as (select case {LEVELS} end sparsity_level from rv) select sparsity_level, count(*) n from x group by 1")
def sparsity_bins(spark, d) -> Frame:
    return report.with_sparsity_level(averages(spark, d)).groupBy("sparsity_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RUNS} select array_to_string(string_split(string_split(matrix, '/')[1], '_')[1:2], '_') dlmc_type, count(*) n from rv group by 1")
def dlmc_types(spark, d) -> Frame:
    return averages(spark, d).groupBy(report.dlmc_type().alias("dlmc_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RUNS} select matrix, format, system, k, round(2.0::double * nnz * k / (8 * nnz + 4 * (\"rows\" + 1) + 4.0::double * k * (\"rows\" + cols)), 6) intensity from rv")
def arithmetic_intensity(spark, d) -> Frame:
    return rounded(report.arithmetic_intensity(averages(spark, d)).select("matrix", "format", "system", "k", "intensity"))


ROOFS = [("gflops", "FP64", 700.0), ("gbytes", "L1", 2500.0), ("gbytes", "DRAM", 80.0)]


@query("with b as (select * from (values ('L1', 2500.0::double), ('DRAM', 80.0::double)) t(label, bw)) select label, round(power(10, -2 + i * (4 / 99)), 6) ai, round(least(power(10, -2 + i * (4 / 99)) * bw, 700), 6) gflops from b, (select unnest(range(100)) i)")
def roofline_curve(spark, d) -> Frame:
    return rounded(report.roofline_curve(spark.createDataFrame(ROOFS, "kind string, label string, value double")))


@query("select * from (values ('L1', 0.28::double), ('DRAM', 8.75::double)) t(label, knee)")
def roofline_knees(spark, d) -> Frame:
    return rounded(report.roofline_knees(spark.createDataFrame(ROOFS, "kind string, label string, value double")))
