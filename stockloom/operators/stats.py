"""Year-to-year statistics and rank tests.

Moments and rank sums are aggregates. Ranks over all rows come from value counts with a distributed
running total. Only p-values are short formulas on the driver, over one collected row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.operators.aggregates import one
from stockloom.operators.prefix import average_ranks, exact_quantiles
from stockloom.session import written


def product_means(demand: DataFrame, product: str, date: str, qty: str, years: list[int]) -> DataFrame:
    """Mean daily demand per product and year."""
    kept = demand.where(F.year(date).isin(*years))
    return kept.groupBy(product, F.year(date).alias("year")).agg(F.avg(qty).alias("x"))


def complete_products(means: DataFrame, product: str, years: list[int]) -> DataFrame:
    """Products with a value in every year, one column per year."""
    wide = means.groupBy(product).agg(*[F.max(F.when(F.col("year") == y, F.col("x"))).alias(f"y{y}") for y in years])
    return wide.na.drop()


def descriptive_stats_by_year(means: DataFrame) -> DataFrame:
    base = means.groupBy("year").agg(one().alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    q = exact_quantiles(means, ["year"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(q, "year").select(
        "year", "n", "mean", "median", "std", (F.col("std") / F.col("mean")).alias("cv"), (F.col("q3") - F.col("q1")).alias("iqr")
    )


def year_pairs(wide: DataFrame, key: str, years: list[int]) -> DataFrame:
    """Long form of all year pairs: (pair, key, a, b) where both years have a value."""
    rows = F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"y{a}").alias("a"), F.col(f"y{b}").alias("b"))
        for a, b in combinations(years, 2)
    ])
    return wide.select(key, F.explode(rows).alias("r")).select(key, "r.pair", "r.a", "r.b").where("a is not null and b is not null")


def pearson_by_year_pair(pairs: DataFrame) -> DataFrame:
    got = pairs.groupBy("pair").agg(F.corr("a", "b").alias("pearson"), one().alias("n"))
    return got.withColumn("p", tail(correlation_p, "pearson", "n"))


def daily_curve_pairs(daily: DataFrame, date: str, total: str, years: list[int]) -> DataFrame:
    """Daily totals aligned by month-day, as year pairs."""
    mmdd = D.month_day(date)
    wide = daily.where(mmdd != "02-29").groupBy(mmdd.alias("mmdd")).agg(
        *[F.sum(F.when(F.year(date) == y, F.col(total))).alias(f"y{y}") for y in years]
    )
    return year_pairs(wide, "mmdd", years)


def spearman_by_year_pair(pairs: DataFrame) -> DataFrame:
    pairs = written(pairs)  # each rank reads it again
    ra = average_ranks(pairs, ["pair"], "a", "_ra").select("pair", "a", "_ra")
    rb = average_ranks(pairs, ["pair"], "b", "_rb").select("pair", "b", "_rb")
    return pairs.join(ra, ["pair", "a"]).join(rb, ["pair", "b"]).groupBy("pair").agg(F.corr("_ra", "_rb").alias("spearman"), one().alias("n")).withColumn("p", tail(correlation_p, "spearman", "n"))


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic over groups from count, sum and squared deviations around each group's own mean."""
    # One row per group, read twice below.
    g = written(df.groupBy(group).agg(one().alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("ss")))
    grand = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    return g.agg(
        (one() - 1).alias("df_between"),
        (F.sum("n") - one()).alias("df_within"),
        F.sum(F.col("n") * F.pow(F.col("m") - grand.scalar(), 2)).alias("_q"),
        F.sum("ss").alias("_w"),
    ).select(
        "df_between", "df_within",
        ((F.col("_q") / F.col("df_between")) / (F.col("_w") / F.col("df_within"))).alias("f"),
    ).withColumn("p", tail(f_survival, "f", "df_between", "df_within"))


def levene_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Levene's test around the group medians: the F test on absolute deviations."""
    df = written(df.select(group, value))
    med = exact_quantiles(df, [group], value, {"_med": 0.5})
    return anova_oneway(df.join(med, group).withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), group, "_dev")


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, and its p-value for any number of groups."""
    counted = df.groupBy(group, value).agg(one().alias("_c"))
    ranks = average_ranks(df, [], value, "_r")
    ties = ranks.agg(F.sum(F.pow("n", 3) - F.col("n")).alias("_t"), F.sum("n").cast("double").alias("_n")).select(
        F.struct("_t", "_n").alias("s")
    )
    per = counted.join(ranks.select(value, "_r"), value).groupBy(group).agg(
        F.sum(F.col("_c") * F.col("_r")).alias("_rs"), F.sum("_c").alias("_gn")
    )
    row = per.agg(F.sum(F.pow("_rs", 2) / F.col("_gn")).alias("_q"), one().alias("k")).withColumn("_s", ties.scalar())
    n = F.col("_s._n")
    raw = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    h = raw / (1 - F.col("_s._t") / (F.pow(n, 3) - n))
    return row.select(h.alias("h"), "k").withColumn("p", tail(chi2_survival, "h", F.col("k") - 1))


def friedman(wide: DataFrame, key: str, years: list[int]) -> DataFrame:
    """Chi-square over keys ranked across the years, tie-corrected. A key has one value per year."""
    k = len(years)
    vals = F.array(*[F.col(f"y{y}") for y in years])

    def rank_of(y: int) -> Column:
        v = F.col(f"y{y}")
        below = F.size(F.filter(vals, lambda x: x < v))
        same = F.size(F.filter(vals, lambda x: x == v))
        return below + (same + 1) / 2

    def tie_term() -> Column:
        # Each of t tied values adds t^2 - 1, together t^3 - t.
        each = F.transform(vals, lambda x: F.size(F.filter(vals, lambda z: z == x)))
        return F.aggregate(each, F.lit(0.0), lambda acc, t: acc + t * t - 1)

    row = wide.agg(
        *[F.sum(rank_of(y)).alias(f"_r{y}") for y in years], F.sum(tie_term()).alias("_t"), one().cast("double").alias("_n")
    )
    n = F.col("_n")
    q = sum((F.pow(f"_r{y}", 2) for y in years), F.lit(0.0))
    raw = 12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)
    chi = raw / (1 - F.col("_t") / (n * k * (k * k - 1)))
    out = row.select(chi.alias("chi2"), F.col("_n").cast("long").alias("n"))
    return out.withColumn("p", tail(chi2_survival, "chi2", F.lit(k - 1)))


def wilcoxon_pairs(pairs: DataFrame) -> DataFrame:
    """Signed-rank statistic and its normal score per pair; zero differences are left out."""
    d = pairs.withColumn("_d", F.col("a") - F.col("b")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranks = average_ranks(d, ["pair"], "_abs", "_r")
    ties = ranks.groupBy("pair").agg(F.sum(F.pow("n", 3) - F.col("n")).alias("_t"))
    sums = d.join(ranks.select("pair", "_abs", "_r"), ["pair", "_abs"]).groupBy("pair").agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_p"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("_m"),
        one().alias("n"),
    )
    n = F.col("n").cast("double")
    w = F.least("_p", "_m")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48
    scored = sums.join(ties, "pair").select("pair", "n", w.alias("w"), ((w - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))
    tests = pairs.select("pair").distinct().agg(one()).scalar()
    judged = scored.withColumn("p", tail(normal_two_sided, "z"))
    return judged.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * tests))


def dagostino_normality(df: DataFrame, group: str, value: str) -> DataFrame:
    """K2 from skewness and kurtosis per group, and its p-value exp(-K2/2)."""
    mean = df.groupBy(group).agg(F.avg(value).alias("_m"))
    c = df.join(mean, group).withColumn("_c", F.col(value) - F.col("_m"))
    m = c.groupBy(group).agg(
        one().cast("double").alias("n"), F.avg(F.pow("_c", 2)).alias("m2"), F.avg(F.pow("_c", 3)).alias("m3"), F.avg(F.pow("_c", 4)).alias("m4")
    )
    n = F.col("n")
    # Skewness score.
    y = F.col("m3") / F.pow("m2", 1.5) * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(scaled) / F.sqrt(0.5 * F.log(w2))
    # Kurtosis score.
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    x = (F.col("m4") / F.pow("m2", 2) - 3 * (n - 1) / (n + 1)) / spread
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(denom) * F.cbrt((1 - 2 / a) / F.abs(denom))) / F.sqrt(2 / (9 * a))
    out = m.select(group, F.col("n").cast("long").alias("n"), z1.alias("z_skew"), z2.alias("z_kurt"))
    k2 = F.pow("z_skew", 2) + F.pow("z_kurt", 2)
    return out.withColumn("k2", k2).withColumn("p", F.exp(-F.col("k2") / 2))


# ---- p-values from one collected row -------------------------------------------------------------


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tail(fn: Callable[..., float], *cols: str | Column) -> Column:
    """A p-value column over the few rows of a test's result. A null or undefined statistic has a null p."""

    def of(*series: pd.Series) -> pd.Series:
        rows = zip(*series)
        return pd.Series([fn(*map(float, r)) if not any(pd.isna(v) for v in r) else None for r in rows], dtype="float64")

    return F.pandas_udf(of, "double")(*[c if isinstance(c, Column) else F.col(c) for c in cols])


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation over ``n`` pairs: t squared is F with (1, n - 2) degrees of freedom."""
    if n <= 2:
        return 1.0
    return f_survival(r * r * (n - 2) / (1 - r * r), 1, n - 2) if abs(r) < 1 else 0.0


def chi2_survival(x: float, df: float) -> float:
    """P(X > x) for chi-square: the upper incomplete gamma integral by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - front * total)
    value = 0.0
    for i in range(300, 0, -1):
        value = i * (i - a) / (y + 2 * i + 1 - a - value)
    return front / (y + 1 - a - value)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral, evaluated from its far end."""
    value = 0.0
    for i in range(400, 0, -1):
        m = i // 2
        if i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = term / (1 + value)
    return 1 / (1 + value)


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F distribution with (d1, d2) degrees of freedom."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b
