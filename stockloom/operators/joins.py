"""Joins. No side carries a broadcast hint: Spark broadcasts a side after it has measured its size."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.text import parse_scope_values
from stockloom.operators.calendar import expand_windows_daily
from stockloom.operators.aggregates import count_if, one


def enrich_mean_price_join(demand: DataFrame, prices: DataFrame, product: str, price: str) -> DataFrame:
    mean = prices.groupBy(product).agg(F.avg(price).alias("mean_price"))
    return demand.join(mean, product, "left")


def _one_cluster(lookup: DataFrame, product: str, cluster: str) -> DataFrame:
    return lookup.where(F.col(cluster).isNotNull()).groupBy(product).agg(F.min(cluster).alias(cluster))


def assign_clusters_join(demand: DataFrame, lookup: DataFrame, product: str, cluster: str) -> DataFrame:
    """Demand with its cluster; a repeated lookup key gives one row, unmatched rows are left out."""
    return demand.join(_one_cluster(lookup, product, cluster), product)


def products_without_cluster(demand: DataFrame, lookup: DataFrame, product: str, cluster: str) -> DataFrame:
    """Counts first, then the anti join: the shuffle carries one row per product."""
    per = demand.groupBy(product).agg(one().alias("rows"))
    missing = per.join(_one_cluster(lookup, product, cluster), product, "left_anti")
    return missing.withColumn("reason", F.lit("sin_cluster"))


def anti_join_products(df: DataFrame, listed: DataFrame, product: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the products that were really removed."""
    keys = listed.select(product).distinct()
    return df.join(keys, product, "left_anti"), df.join(keys, product, "left_semi").select(product).distinct()


def catalog_split(catalog: DataFrame, demand: DataFrame, product: str) -> DataFrame:
    """Every catalogue row with its part: ``final``, ``discarded`` or ``new`` (no id)."""
    sold = demand.select(product).distinct().withColumn("_sold", F.lit(1))
    part = F.when(F.col(product).isNull(), "new").when(F.col("_sold") == 1, "final").otherwise("discarded")
    return catalog.join(sold, product, "left").withColumn("part", part).drop("_sold")


def internal_alternatives_join(offers: DataFrame, preferred: DataFrame, product: str, supplier: str) -> DataFrame:
    """Every offer of a product that is not its preferred one, next to the preferred values."""
    p = preferred.select(product, *[F.col(c).alias(f"pref_{c}") for c in preferred.columns if c != product])
    return offers.join(p, product).where(F.col(supplier) != F.col(f"pref_{supplier}"))


def zero_fill_universe(universe: DataFrame, totals: DataFrame, product: str, qty: str) -> DataFrame:
    """Every product of the universe with its total, 0 where there is none; one row per product."""
    t = totals.groupBy(product).agg(F.sum(qty).alias(qty))
    return universe.select(product).distinct().join(t, product, "left").withColumn(qty, F.coalesce(qty, F.lit(0.0)))


def outlier_calendar_join(days: DataFrame, event_days: DataFrame, date: str = "date") -> DataFrame:
    """Candidate days with the events of their date. Names are folded per date before the join."""
    names = event_days.groupBy(F.col("date").alias("_d")).agg(
        F.array_join(F.array_sort(F.collect_set("event")), "; ").alias("events")
    )
    joined = days.join(names, F.col(date) == F.col("_d"), "left").drop("_d")
    return joined.withColumn("justified", F.col("events").isNotNull())


def tag_product_year(df: DataFrame, tags: DataFrame, product: str, date: str, cols: list[str], default: str = "none") -> DataFrame:
    t = tags.select(product, "year", *cols)
    out = df.withColumn("year", F.year(date)).join(t, [product, "year"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(default)) for c in cols})


def product_master_outer_join(catalog: DataFrame, suppliers: DataFrame, product: str, order: str) -> DataFrame:
    """Full outer join of the catalogue and the supplier map, one row per product on both sides.

    Of several catalogue rows of a product the least one by all its columns stays, of several suppliers
    the first by (order, supplier).
    """
    s = suppliers.groupBy(product).agg(F.min_by("supplier", F.struct(order, "supplier")).alias("map_supplier"))
    rest = [c for c in catalog.columns if c != product]
    c = catalog.groupBy(product).agg(F.min(F.struct(*rest)).alias("_row")).select(product, *[F.col(f"_row.{n}").alias(n) for n in rest])
    return c.join(s, product, "full")


def price_map_coalesce(preferred: DataFrame, catalog: DataFrame, product: str) -> DataFrame:
    """Preferred price, else the catalogue mean."""
    mean = catalog.groupBy(product).agg(F.avg("price").alias("_mean"))
    pref = preferred.select(product, F.col("price").alias("_pref"))
    return mean.join(pref, product, "full").select(product, F.coalesce("_pref", "_mean").alias("price"))


def price_multiplier_priority_join(
    df: DataFrame, by_product: DataFrame, by_cluster: DataFrame, product: str, cluster: str, date: str
) -> DataFrame:
    """The multiplier of the product and day, else of the cluster and day, else 1."""
    p = by_product.select(product, date, F.col("m").alias("_mp"))
    c = by_cluster.select(cluster, date, F.col("m").alias("_mc"))
    joined = df.join(p, [product, date], "left").join(c, [cluster, date], "left")
    return joined.withColumn("multiplier", F.coalesce("_mp", "_mc", F.lit(1.0))).drop("_mp", "_mc")


def affected_days_metrics_join(df: DataFrame, days: DataFrame, product: str, date: str, qty: str) -> DataFrame:
    """Share of products, rows and sales on candidate days, in one pass over the joined rows."""
    hit = days.select(product, date).distinct().withColumn("_hit", F.lit(1))
    j = df.join(hit, [product, date], "left")
    on = F.col("_hit") == 1
    return j.agg(
        one().alias("rows"),
        count_if(on).alias("rows_affected"),
        F.countDistinct(product).alias("products"),
        F.countDistinct(F.when(on, F.col(product))).alias("products_affected"),
        (100 * count_if(on) / one()).alias("rows_pct"),
        (100 * F.countDistinct(F.when(on, F.col(product))) / F.countDistinct(product)).alias("products_pct"),
        (100 * F.sum(F.when(on, F.col(qty)).otherwise(0.0)) / F.sum(qty)).alias("sales_pct"),
    )


def event_window_range_join(daily: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """Daily rows inside each window. Windows are expanded to days, so this is an equi join on the day."""
    days = expand_windows_daily(windows, date="_day")
    return daily.join(days, F.col(date) == F.col("_day")).drop("_day")


def scope_window_join(windows: DataFrame, clusters: list[int], product_cluster: DataFrame | None = None) -> DataFrame:
    """Windows to the clusters they touch.

    ``global`` and unknown scopes touch all clusters, ``cluster`` its list (all if empty), ``product_id``
    the clusters of its products (all if none is known).
    """
    every = F.array(*[F.lit(c).cast("long") for c in clusters])
    listed = parse_scope_values("scope_values")
    kind = F.lower(F.col("scope_type"))
    direct = F.when((kind == "cluster") & (F.size(listed) > 0), listed).otherwise(every)
    if product_cluster is None:
        return windows.withColumn("cluster_id", F.explode(F.array_distinct(direct).cast("array<int>")))
    per_product = windows.where(kind == "product_id").select("id", F.explode(listed).alias("product_id"))
    known = per_product.join(product_cluster.select("product_id", "cluster_id"), "product_id").groupBy("id").agg(
        F.array_sort(F.collect_set(F.col("cluster_id").cast("long"))).alias("_known")
    )
    targets = F.when(kind == "product_id", F.coalesce("_known", every)).otherwise(direct)
    joined = windows.join(known, "id", "left")
    return joined.withColumn("cluster_id", F.explode(F.array_distinct(targets).cast("array<int>"))).drop("_known")


def scope_product_join(windows: DataFrame, product_cluster: DataFrame) -> DataFrame:
    """Windows of scope ``product_id`` to their known products, with the cluster of each."""
    rows = windows.where(F.lower("scope_type") == "product_id").withColumn("product_id", F.explode(parse_scope_values("scope_values")))
    return rows.join(product_cluster.select("product_id", "cluster_id"), "product_id")


def cohort_intersection(df: DataFrame, product: str, date: str) -> DataFrame:
    """Rows of the products seen in every year of the data."""
    pairs = df.select(product, F.year(date).alias("_y")).distinct()
    years = df.agg(F.countDistinct(F.year(date)).alias("n"))
    full = pairs.groupBy(product).agg(one().alias("_n")).where(F.col("_n") == years.scalar()).select(product)
    return df.join(full, product, "left_semi")


def enrich_external_substitutes(subs: DataFrame, catalog: DataFrame, preferred: DataFrame, stock: DataFrame) -> DataFrame:
    """Substitutes with the data of the substitute, and price, lead time and availability against the product's preferred offer."""
    names = catalog.select(
        F.col("product_id").alias("substitute_id"), F.col("name").alias("sub_name"), F.col("category").alias("sub_category"), F.col("supplier").alias("sub_supplier")
    )
    own = preferred.select("product_id", *[F.col(c).alias(f"_own_{c}") for c in ("price", "lead_time", "availability")])
    sub = preferred.select(F.col("product_id").alias("substitute_id"), F.col("price").alias("sub_price"), F.col("lead_time").alias("sub_lead_time"), F.col("availability").alias("_sub_av"))
    live = stock.select(F.col("product_id").alias("substitute_id"), F.col("stock").cast("double").alias("_live"))
    j = subs.join(names, "substitute_id", "left").join(sub, "substitute_id", "left").join(live, "substitute_id", "left").join(own, "product_id", "left")
    available = F.coalesce("_live", "_sub_av")
    return j.select(
        "product_id", "substitute_id", "score", "sub_name", "sub_category", "sub_supplier", "sub_price", "sub_lead_time",
        available.alias("sub_availability"),
        (F.col("sub_price") - F.col("_own_price")).alias("delta_price"),
        (F.col("sub_lead_time") - F.col("_own_lead_time")).alias("delta_lead_time"),
        (available - F.col("_own_availability")).alias("delta_availability"),
    )


def catalog_enrichment_join(demand: DataFrame, catalog: DataFrame, product: str) -> DataFrame:
    return demand.join(catalog.select(product, "category", "status"), product, "left")


def enrichment_summary(enriched: DataFrame, product: str) -> DataFrame:
    return enriched.agg(
        one().alias("rows"),
        count_if(F.col("category").isNull()).alias("without_category"),
        count_if(F.col("status").isNull()).alias("without_status"),
        F.countDistinct(product).alias("products"),
    )
