"""Published views: one table per screen or engine input, all keyed by product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.pricing import lead_time_bucket
from stockloom.operators.aggregates import count_if, one
from stockloom.operators.cleaning import low_stock_flag
from stockloom.operators.windows import preferred_supplier_priority_first, rank_external, rank_internal


def view_supplier_preferred(offers: DataFrame) -> DataFrame:
    best = preferred_supplier_priority_first(offers)
    return best.select(
        "product_id", F.col("supplier_id").alias("preferred_supplier_id"), F.col("price").alias("preferred_price"),
        F.col("lead_time").alias("preferred_lead_time"), F.col("availability").alias("preferred_availability"),
        F.col("priority").alias("preferred_priority"), lead_time_bucket("lead_time").alias("preferred_bucket"),
    )


def view_ui_substitutes(unified: DataFrame, min_score: float = 0.70) -> DataFrame:
    """Internal alternatives ranked by offer, external ones by score."""
    inner = rank_internal(unified.where("kind = 'interno'"))
    return inner.unionByName(rank_external(unified.where("kind = 'externo'"), min_score))


def view_ui_products(
    ui_substitutes: DataFrame, preferred: DataFrame, catalog: DataFrame | None = None, stock: DataFrame | None = None, use: DataFrame | None = None
) -> DataFrame:
    """Counts, preferred offer and best external substitute of every product with a substitute."""
    outer = F.col("kind") == "externo"
    counts = ui_substitutes.groupBy("product_id").agg(
        count_if(F.col("kind") == "interno").alias("internal_count"), count_if(outer).alias("external_count"),
        F.max(F.when(outer & (F.col("rank") == 1), F.col("substitute_id"))).alias("top_external_id"),
        F.max(F.when(outer & (F.col("rank") == 1), F.col("score"))).alias("top_external_score"),
    )
    out = counts.join(preferred, "product_id", "left")
    for extra in (catalog, stock, use):
        if extra is not None:
            out = out.join(extra, "product_id", "left")
    return out


def view_substitution_rules(ui_substitutes: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "interno", "internal").when(F.col("kind") == "externo", "external")
    return ui_substitutes.select(
        "product_id", F.col("substitute_id").alias("alt_product_id"), F.col("supplier_id").alias("alt_supplier_id"), "score", "price",
        "lead_time", "availability", "priority", "rank", kind.alias("alt_type"),
    )


def view_replenishment(preferred: DataFrame, ui_substitutes: DataFrame, stock: DataFrame, use: DataFrame | None = None) -> DataFrame:
    n = ui_substitutes.groupBy("product_id").agg(one().alias("substitutes_n"))
    out = preferred.join(n, "product_id", "left").withColumn("substitutes_n", F.coalesce("substitutes_n", F.lit(0).cast("long")))
    out = out.join(stock, "product_id", "left")
    return out if use is None else out.join(use, "product_id", "left")


def daily_use(demand: DataFrame, stock: DataFrame, last: str) -> DataFrame:
    """Units of the last 30 and 90 days, mean per day and days of cover."""
    end = F.lit(last).cast("date")
    age = F.datediff(end, "date")
    recent = demand.where((age >= 0) & (age < 90)).groupBy("product_id").agg(
        F.sum(F.when(age < 30, F.col("qty")).otherwise(0.0)).alias("use_30d"), F.sum("qty").alias("use_90d")
    )
    out = stock.join(recent, "product_id", "left").withColumn("use_daily", F.coalesce("use_90d", F.lit(0.0)) / 90)
    cover = F.col("on_hand") / F.nullif(F.col("use_daily"), F.lit(0.0))
    return out.select("product_id", F.coalesce("use_30d", F.lit(0.0)).alias("use_30d"), F.coalesce("use_90d", F.lit(0.0)).alias("use_90d"), "use_daily", cover.alias("cover_days"))


def supplier_catalog_table(catalog: DataFrame, stock: DataFrame, supplier: str) -> DataFrame:
    own = catalog.where(F.col("supplier") == supplier)
    return own.join(stock, "product_id", "left").select("product_id", "name", "category", "price", "stock").orderBy("name", "product_id")


def product_explorer_table(catalog: DataFrame, preferred: DataFrame, counts: DataFrame, stock: DataFrame, low: float = 20) -> DataFrame:
    out = catalog.select("product_id", "name", "category").join(preferred, "product_id", "left").join(counts, "product_id", "left").join(stock, "product_id", "left")
    return out.withColumn("stock_flag", low_stock_flag("stock", low))
