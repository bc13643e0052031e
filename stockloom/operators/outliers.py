"""Outlier flags and product classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.prefix import exact_quantiles
from stockloom.session import written


def iqr_bounds(df: DataFrame, product: str, qty: str, k: float = 1.5) -> DataFrame:
    """Lower and upper bound per product; none where the inter-quartile range is not positive.

    The frame is a daily table, so a product has at most one value per calendar day.
    """
    q = df.groupBy(product).agg(
        F.percentile(qty, 0.25).alias("_q1"), F.percentile(qty, 0.75).alias("_q3")
    )
    iqr = F.col("_q3") - F.col("_q1")
    return q.where(iqr > 0).select(product, (F.col("_q1") - k * iqr).alias("low"), (F.col("_q3") + k * iqr).alias("high"))


def iqr_outliers(df: DataFrame, product: str, qty: str, k: float = 1.5) -> DataFrame:
    outside = (F.col(qty) < F.col("low")) | (F.col(qty) > F.col("high"))
    joined = df.join(iqr_bounds(df, product, qty, k), product, "left")
    return joined.withColumn("is_outlier", F.coalesce(outside, F.lit(False))).drop("low", "high")


def mad_outlier_flags(
    df: DataFrame,
    product: str = "product_id",
    date: str = "date",
    qty: str = "qty",
    z: float = 3.5,
    k: float = 4.0,
    p95: float = 0.95,
    p99: float = 0.99,
) -> DataFrame:
    """Three flags per day against its own product and year.

    Two passes: quantiles of the values, then the median of the absolute deviations. Both are grouped
    aggregates over (product, year), at most 366 daily values each, joined back to the rows.
    """
    base = df.withColumn("year", F.year(date)).where(F.col(qty).isNotNull() & (F.col(qty) >= 0))
    keys = [product, "year"]
    level = base.groupBy(*keys).agg(
        F.percentile(qty, 0.5).alias("_med"),
        F.percentile(qty, p95).alias("_p95"),
        F.percentile(qty, p99).alias("_p99"),
    )
    centred = base.join(level, keys).withColumn("_dev", F.abs(F.col(qty) - F.col("_med")))
    w = Window.partitionBy(*keys)
    spread = centred.withColumn("_mad", F.median("_dev").over(w))
    flat = F.col("_mad") <= 1e-8
    score = F.when(flat, F.lit(0.0)).otherwise(0.6745 * (F.col(qty) - F.col("_med")) / F.col("_mad"))
    x = F.col(qty)
    above99 = x > F.col("_p99")
    out = (
        spread.withColumn("robust_z", score)
        .withColumn("flag_z", F.abs("robust_z") > z)
        .withColumn("flag_p99", above99)
        .withColumn(
            "flag_p95kmad",
            F.when(flat, above99).otherwise((x > F.col("_p95")) & (x > F.col("_med") + k * F.col("_mad"))),
        )
        .withColumn("flag_any", F.col("flag_z") | F.col("flag_p99") | F.col("flag_p95kmad"))
    )
    return out.drop("_med", "_p95", "_p99", "_dev", "_mad")


def top_by_year(yearly: DataFrame, total: str, year: str, top_n: int | None, percentile: float, product: str = "product_id") -> DataFrame:
    """``is_top``: in the yearly top N or at or above the percentile of the year's totals.

    A year holds every product, so the threshold comes from :func:`exact_quantiles`; ``row_number`` with
    a fixed limit is pruned by Spark inside each task before the shuffle.
    """
    limit = exact_quantiles(yearly, [year], total, {"_limit": percentile})
    out = yearly.join(limit, year).withColumn("is_top", F.col(total) >= F.col("_limit"))
    if top_n is not None:
        w = Window.partitionBy(year).orderBy(F.col(total).desc(), F.col(product))
        best = yearly.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n).select(product, year, F.lit(True).alias("_best"))
        out = out.join(best, [product, year], "left").withColumn("is_top", F.col("is_top") | F.coalesce("_best", F.lit(False))).drop("_best")
    return out.drop("_limit")


def decision_for(kind: Column) -> Column:
    # Decision by outlier type.
    return (
        F.when(kind == "top_venta", "sin_cambio")
        .when(kind == "pico_aislado", "suavizado_a015")
        .when(kind == "mixto", "alerta_pendiente")
    )


def classify_product_year(
    flags: DataFrame, product: str = "product_id", qty: str = "qty", isolated: float = 0.05, percentile: float = 0.99, top_n: int | None = None
) -> DataFrame:
    """top_venta, pico_aislado or mixto per product and year, with the decision."""
    yearly = flags.groupBy(product, "year").agg(
        F.sum(qty).alias("year_total"), F.avg(F.col("flag_any").cast("double")).alias("share_flagged")
    )
    topped = top_by_year(written(yearly), "year_total", "year", top_n, percentile, product)
    kind = F.when(F.col("is_top"), "top_venta").when(F.col("share_flagged") < isolated, "pico_aislado").otherwise("mixto")
    return topped.withColumn("kind", kind).withColumn("decision", decision_for(F.col("kind"))).drop("is_top")


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "top_venta", 0).when(kind == "mixto", 1).when(kind == "pico_aislado", 2).otherwise(3)


def consolidate_by_priority(a: DataFrame, b: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Two classifications per key: the stronger type wins."""
    both = a.select(*keys, kind).unionByName(b.select(*keys, kind))
    best = both.groupBy(*keys).agg(F.min_by(kind, kind_rank(F.col(kind))).alias(kind))
    return best.withColumn("decision", decision_for(F.col(kind)))
