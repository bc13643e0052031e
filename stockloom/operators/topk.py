"""Top-k selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.prefix import row_positions


def top_products_by_units(df: DataFrame, product: str, qty: str, k: int = 25) -> DataFrame:
    total = df.groupBy(product).agg(F.sum(qty).alias("units"))
    return total.orderBy(F.desc("units"), product).limit(k)


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_substitutes(subs: DataFrame, broken: DataFrame, product: str, substitute: str, score: str, k: int = 3) -> DataFrame:
    kept = subs.join(broken.select(product).distinct(), product, "left_semi")
    return top_k_per_group(kept, product, [F.desc(score), substitute], k)


def representative_subset(products: DataFrame, cluster: str, product: str, demand: str, cv: str, flag: str, big: list[int], frac: float) -> DataFrame:
    """All flagged products, all of the small clusters, and of each big cluster the top share by (demand, cv).

    The share is counted and ranked among the products that are not flagged. A big cluster may hold most
    products, so its positions come from a distributed order.
    """
    flagged = F.coalesce(F.col(flag), F.lit(0)) == 1
    small = products.where(F.coalesce(~F.col(cluster).isin(*big), F.lit(True)) | flagged)
    large = products.where(F.col(cluster).isin(*big) & ~flagged)
    order = [F.col(demand).desc_nulls_last(), F.col(cv).desc_nulls_last(), F.col(product).asc()]
    placed = row_positions(large, [cluster], order, "_pos")
    sizes = large.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("_pos") <= F.floor(F.col("_n") * frac)
    return small.unionByName(placed.join(sizes, cluster).where(keep).select(*products.columns))


def top_k_importance(df: DataFrame, feature: str, value: str, k: int) -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias("importance")).orderBy(F.desc("importance"), feature).limit(k)
