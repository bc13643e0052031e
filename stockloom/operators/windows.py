"""Window operators over daily series, rankings and running values.

Series windows are partitioned by a series key over a daily table: a group has at most one row per
calendar day. Rankings keep the first k rows by ``row_number() <= k``, which Spark prunes inside each
map task. Orders whose groups have no bound use the helpers of ``prefix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.prefix import row_positions, running_total


def _series(groups: list[str], date: str):
    return Window.partitionBy(*groups).orderBy(date)


def lag_features(df: DataFrame, groups: list[str], date: str, cols: list[str], lags: list[int]) -> DataFrame:
    w = _series(groups, date)
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in cols for n in lags})


def rolling_mean_shifted(df: DataFrame, groups: list[str], date: str, cols: list[str], widths: list[int], min_frac: float = 0.6) -> DataFrame:
    """Mean of the previous rows without the current one, null where too few values are present."""
    new = {}
    for c in cols:
        for n in widths:
            past = _series(groups, date).rowsBetween(-n, -1)
            enough = F.count(c).over(past) >= math.ceil(min_frac * n)
            new[f"{c}_roll{n}"] = F.when(enough, F.avg(c).over(past))
    return df.withColumns(new)


def centered_rolling_mean(df: DataFrame, groups: list[str], date: str, col: str, half: int = 3) -> DataFrame:
    return df.withColumn(f"{col}_smooth", F.avg(col).over(_series(groups, date).rowsBetween(-half, half)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def keep_last_by_priority(df: DataFrame, keys: list[str], flag: str, tie: list[Column]) -> DataFrame:
    return keep_first(df, keys, [F.col(flag).desc_nulls_last(), *tie])


def stock_first_order(supplier: str = "supplier_id") -> list[Column]:
    return [F.col("availability").desc_nulls_last(), F.col("lead_time").asc_nulls_last(), F.col("price").asc_nulls_last(), F.col("priority").asc_nulls_last(), F.col(supplier).asc()]


def priority_first_order(supplier: str = "supplier_id") -> list[Column]:
    return [F.col("priority").asc_nulls_last(), F.col("price").asc_nulls_last(), F.col("lead_time").asc_nulls_last(), F.col("availability").desc_nulls_last(), F.col(supplier).asc()]


def preferred_supplier_stock_first(offers: DataFrame, product: str = "product_id") -> DataFrame:
    return keep_first(offers, [product], stock_first_order())


def preferred_supplier_priority_first(offers: DataFrame, product: str = "product_id") -> DataFrame:
    return keep_first(offers, [product], priority_first_order())


def cheapest_supplier(offers: DataFrame, product: str = "product_id", supplier: str = "supplier_id") -> DataFrame:
    return keep_first(offers, [product], [F.col("price").asc_nulls_last(), F.col(supplier)])


def repair_single_preferred(offers: DataFrame, product: str = "product_id", supplier: str = "supplier_id") -> DataFrame:
    """Exactly one priority 1 per product: where there is none or several, the best row becomes 1 and the rest 2."""
    ones = F.sum(F.when(F.col("priority") == 1, 1).otherwise(0))
    broken = offers.groupBy(product).agg(ones.alias("_ones")).where("_ones <> 1").select(product)
    best = preferred_supplier_priority_first(offers.join(broken, product, "left_semi"), product).select(
        product, F.col(supplier).alias("_best")
    )
    joined = offers.join(best, product, "left")
    fixed = F.when(F.col("_best").isNull(), F.col("priority")).when(F.col(supplier) == F.col("_best"), 1).otherwise(2)
    return joined.withColumn("priority", fixed.cast("int")).drop("_best")


def rank_internal(internal: DataFrame, product: str = "product_id", supplier: str = "supplier_id") -> DataFrame:
    """Running rank of a product's alternative offers, from a distributed order: a product may hold most of the offers."""
    return _ranked(internal, product, [*priority_first_order(supplier)])


def rank_external(external: DataFrame, min_score: float = 0.70, product: str = "product_id", substitute: str = "substitute_id") -> DataFrame:
    """Rank of a product's substitutes by score, for any number of them."""
    return _ranked(external.where(F.col("score") >= min_score), product, [F.col("score").desc(), F.col(substitute).asc()])


def _ranked(rows: DataFrame, product: str, order: list[Column]) -> DataFrame:
    return row_positions(rows, [product], order, "rank").withColumn("rank", F.col("rank").cast("int"))


def running_stock_ledger(lines: DataFrame, inventory: DataFrame, product: str, day: str, order: list[str], qty: str, stock: str) -> DataFrame:
    """A ledger row per order line of a known item, with the stock after it.

    The running total is cut by day: an item with a third of all lines is spread over its days.
    """
    known = lines.join(inventory.select(product, F.col(stock).alias("_start")), product)
    total = running_total(known, [product], day, [F.col(c) for c in order], qty, "_sold")
    return total.withColumn("movement", F.lit("venta")).withColumn("stock_after", F.col("_start") - F.col("_sold")).drop("_start", "_sold")


def normalize_importance_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Value over the group's sum in percent; unchanged where the sum is 0."""
    total = df.groupBy(group).agg(F.sum(value).alias("_sum"))
    share = F.when(F.col("_sum") == 0, F.col(value)).otherwise(100 * F.col(value) / F.col("_sum"))
    return df.join(total, group).withColumn(value, share).drop("_sum")


def best_model_per_cluster(df: DataFrame, cluster: str, metric: str, model: str) -> DataFrame:
    return keep_first(df, [cluster], [F.col(metric).asc_nulls_last(), F.col(model)])


def highest_lift_window_wins(df: DataFrame, keys: list[str], m: str = "m", window_id: str = "id") -> DataFrame:
    return keep_first(df, keys, [F.abs(F.col(m) - 1).desc(), F.col(window_id)])


def latest_row_per_key(df: DataFrame, keys: list[str], date: str, tie: list[Column] = ()) -> DataFrame:
    return keep_first(df, keys, [F.col(date).desc(), *tie])


def duplicates_keep_all(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a repeated key: a count with map-side combine, then a semi join."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return df.join(repeated, keys, "left_semi")


def z_scale_per_cluster(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Null becomes 0, then (x - mean) / population std inside each cluster; a constant column becomes 0.

    The moments are one row per cluster and are joined back: no window holds a whole cluster.
    """
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    aggs = [f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    joined = filled.join(filled.groupBy(cluster).agg(*aggs), cluster)
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in cols}
    return joined.withColumns(scaled).select(*df.columns)


def forward_fill_exog(df: DataFrame, groups: list[str], date: str, cols: list[str]) -> DataFrame:
    """Last known value, else the first later one, else 0."""
    w = _series(groups, date)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    later = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(later), F.lit(0.0)) for c in cols}
    )
