"""Summary and error metrics, each an aggregate Column: any number of them run in one pass."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.model import column

EPS = sys.float_info.epsilon
C = str | Column


def count_over(v: C, least: float) -> Column:
    return F.count_if(column(v) > least)


def pnorm(v: C, p: float) -> Column:
    if p < 1:
        raise ValueError("p is 1 or more")
    return F.pow(F.sum(F.pow(F.abs(column(v)), p)), 1.0 / p)


def arg_min(v: C, index: C) -> Column:
    """The first index of the least value."""
    return F.min_by(column(index), F.struct(column(v).alias("v"), column(index).alias("i")))


def arg_max(v: C, index: C) -> Column:
    """The first index of the largest value."""
    return F.max_by(column(index), F.struct(column(v).alias("v"), (-column(index)).alias("i")))


def moment(v: C, n: int, center: float | Column = 0.0) -> Column:
    """mean((v - center)^n); n = 0 is taken as 1."""
    c = center if isinstance(center, Column) else F.lit(float(center))
    return F.avg(F.pow(column(v) - c, max(1, n)))


def standardized_moment(v: C, n: int, center: float | Column, std: float | Column) -> Column:
    c, s = (x if isinstance(x, Column) else F.lit(float(x)) for x in (center, std))
    return F.avg(F.pow((column(v) - c) / s, max(1, n)))


def mean(v: C) -> Column:
    return F.avg(column(v))


def mean_abs(v: C) -> Column:
    return F.avg(F.abs(column(v)))


def geometric_mean(v: C) -> Column:
    return F.exp(F.avg(F.ln(F.abs(column(v)))))


def harmonic_mean(v: C) -> Column:
    return 1 / F.avg(1 / column(v))


def rms(v: C) -> Column:
    return F.sqrt(F.avg(column(v) * column(v)))


def mean_absolute_deviation(v: C, center: float | Column) -> Column:
    return F.avg(F.abs(column(v) - (center if isinstance(center, Column) else F.lit(float(center)))))


def variance(v: C) -> Column:
    return F.var_pop(column(v))


def variance_about(v: C, center: float | Column) -> Column:
    return moment(v, 2, center)


def std(v: C) -> Column:
    return F.stddev_pop(column(v))


def mae(a: C, f: C) -> Column:
    return F.avg(F.abs(column(a) - column(f)))


def max_abs_error(a: C, f: C) -> Column:
    return F.max(F.abs(column(a) - column(f)))


def mse(a: C, f: C) -> Column:
    return F.avg(F.pow(column(a) - column(f), 2))


def mare(a: C, f: C) -> Column:
    return F.avg(F.abs(column(a) - column(f)) / F.greatest(F.abs(column(a)), F.lit(EPS)))


def mape(a: C, f: C) -> Column:
    return 100 * mare(a, f)


def smare(a: C, f: C) -> Column:
    return F.avg(F.abs(column(a) - column(f)) / F.greatest(F.abs(column(a)) + F.abs(column(f)), F.lit(EPS)))


def smape(a: C, f: C) -> Column:
    return 100 * smare(a, f)


def q_error(a: C, f: C) -> Column:
    """mean |f/a|, where equal values count as 1."""
    a, f = column(a), column(f)
    return F.avg(F.when(F.abs(a - f) <= 2 * EPS, F.lit(1.0)).otherwise(F.abs(F.try_divide(f, a))))


def ln_q_error(a: C, f: C) -> Column:
    """mean of log10 |f| - log10 |a|."""
    size = lambda x: F.log10(F.greatest(F.abs(column(x)), F.lit(EPS)))
    return F.avg(size(f) - size(a))


def mlare(a: C, f: C) -> Column:
    return F.log10(F.abs(F.pow(F.lit(10.0), ln_q_error(a, f)) - 1))


def gmare(a: C, f: C) -> Column:
    return F.pow(F.lit(10.0), mlare(a, f))


def smlare(a: C, f: C) -> Column:
    a, f = column(a), column(f)
    return F.avg(F.log10((F.abs(a - f) + EPS) / (F.greatest(F.abs(a) + F.abs(f), F.lit(EPS)) + EPS)))


def unique_num(v: C) -> Column:
    return F.count_distinct(column(v))


#: alpha and beta of continuous quantile methods: virtual index N q + alpha + q (1 - alpha - beta) - 1 of the sorted values.
CONTINUOUS = {
    "interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "linear": (1.0, 1.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8),
}
METHODS = ("inverted_cdf", "averaged_inverted_cdf", "closest_observation", *CONTINUOUS)


def virtual_index(n: int, q: float, method: str, compat: bool = False) -> float:
    """Place, from 0, of the q-quantile among n sorted values. compat: the variant that scales n - 1 and shifts up."""
    if method in CONTINUOUS:
        alpha, beta = CONTINUOUS[method]
        shift = alpha + q * (1 - alpha - beta)
        at = (n - 1) * q + shift if compat else n * q + shift - 1
    elif method == "inverted_cdf":
        at = math.ceil(n * q - 1e-12) - 1
    elif method == "averaged_inverted_cdf":
        j = math.floor(n * q + 1e-12)
        at = j - 0.5 if abs(n * q - j) < 1e-9 else j
    elif method == "closest_observation":
        at = round(n * q - 1e-12) - 1 if abs(n * q % 1 - 0.5) > 1e-9 else (lambda j: j - 1 if j % 2 == 0 else j)(math.floor(n * q))
    else:
        raise ValueError(f"{method} is none of {METHODS}")
    return min(max(at, 0.0), n - 1.0)


def quantiles(df: DataFrame, value: str, qs: list[float], method: str = "median_unbiased", compat: bool = False) -> DataFrame:
    """q, value. An order statistic, or a mean of two that lie side by side, is Spark's exact `percentile` at index / (n - 1)."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return df.sparkSession.createDataFrame([(q, None) for q in qs], "q double, value double")
    at = [virtual_index(n, q, method, compat) / max(1, n - 1) for q in qs]
    got = df.agg(F.percentile(value, F.array(*[F.lit(float(x)) for x in at])).alias("p"))
    return got.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(q)) for q in qs]).alias("q"), F.col("p").alias("value")))).toDF("q", "value")
