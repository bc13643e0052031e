"""Aggregations: demand by cluster, coverage, quality counts, profiles, pivots, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.operators.prefix import exact_quantiles
from stockloom.session import written


def one() -> Column:
    return F.count(F.lit(1))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0).cast("long")), F.lit(0).cast("long"))


def demand_cluster_day(df: DataFrame, cluster: str, date: str, target: str, exog: list[str]) -> DataFrame:
    return df.groupBy(cluster, date).agg(F.sum(target).alias(target), *[F.avg(c).alias(c) for c in exog])


def product_features(demand: DataFrame, price: DataFrame | None = None, product: str = "product_id", qty: str = "qty") -> DataFrame:
    """Demand profile per product from a daily table, with the mean price joined after its own aggregation."""
    feats = demand.groupBy(product).agg(
        F.sum(qty).alias("d_total"),
        F.avg(qty).alias("d_mean"),
        F.stddev_samp(qty).alias("d_std"),
        F.percentile(qty, 0.95).alias("p95"),
        F.median(qty).alias("median"),
        one().alias("n"),
    )
    feats = feats.withColumn("cv", F.when(F.col("d_mean") > 0, F.col("d_std") / F.col("d_mean")))
    if price is None:
        return feats
    return feats.join(price.groupBy(product).agg(F.avg("price").alias("mean_price")), product, "left")


def category_features(df: DataFrame, category: str, date: str, qty: str, years: list[int]) -> DataFrame:
    """Seasonal profile of each category: 12 month and 7 weekday shares, yearly totals, growth, spread.

    Rows are first summed to category-days, so the second aggregation reads at most one row per day.
    """
    daily = df.where(F.year(date).isin(*years)).groupBy(category, date).agg(F.sum(qty).alias("_q"))
    q, total = F.col("_q"), F.sum("_q")

    def share(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, q).otherwise(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(0.0))

    months = [share(F.month(date) == m).alias(f"m_{m:02d}") for m in range(1, 13)]
    dows = [share(F.weekday(date) == d).alias(f"dow_{d}") for d in range(7)]
    totals = [F.sum(F.when(F.year(date) == y, q).otherwise(0.0)).alias(f"y{y}") for y in years]
    agg = daily.groupBy(category).agg(
        *months,
        *dows,
        *totals,
        F.avg("_q").alias("_mean"),
        F.stddev_samp("_q").alias("_std"),
        F.percentile("_q", 0.95).alias("_p95"),
        F.median("_q").alias("_med"),
    )
    growth = [
        F.coalesce(F.col(f"y{b}") / F.nullif(F.col(f"y{a}"), F.lit(0.0)) - 1, F.lit(0.0)).alias(f"g_{b % 100:02d}_{a % 100:02d}")
        for a, b in zip(years, years[1:])
    ]
    cv = F.coalesce(F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")), F.lit(0.0)).alias("cv_daily")
    tail = F.coalesce(F.when(F.col("_med") > 0, F.col("_p95") / F.col("_med")), F.lit(0.0)).alias("p95_over_med")
    kept = [c for c in agg.columns if not c.startswith("_")]
    return agg.select(*kept, *growth, cv, tail)


def merge_minor_categories(df: DataFrame, category: str, product: str, qty: str, min_share: float, min_products: int) -> DataFrame:
    """Categories below the demand share or the product count become ``Otros``.

    Rows without a category stay without one, and their demand is in no share.
    """
    per = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(qty).alias("_t"), F.countDistinct(product).alias("_p"))
    total = df.where(F.col(category).isNotNull()).agg(F.sum(qty).alias("t"))
    minor = (F.col("_t") / total.scalar() < min_share) | (F.col("_p") < min_products)
    label = per.where(minor).select(category, F.lit("Otros").alias("_label"))
    return df.join(label, category, "left").withColumn(category, F.coalesce("_label", category)).drop("_label")


def coverage_by_product(df: DataFrame, product: str, date: str, first: str, last: str, scope: str = "overall") -> DataFrame:
    """Days seen over days expected; only years in which a product is present count."""
    inside = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    seen = inside.groupBy(product, F.year(date).alias("_y")).agg(F.countDistinct(date).alias("_seen"))
    expected = D.days_in_year("_y")
    if scope == "overall":
        value = F.sum("_seen") / F.sum(expected)
    elif scope == "per_year":
        value = F.min(F.col("_seen") / expected)
    else:
        raise ValueError(scope)
    return seen.groupBy(product).agg(value.alias("coverage"))


def coverage_by_product_year(df: DataFrame, product: str, date: str) -> DataFrame:
    seen = df.groupBy(product, F.year(date).alias("year")).agg(F.countDistinct(date).alias("observed"))
    expected = D.days_in_year("year").cast("long")
    return seen.select(
        product, "year", "observed", expected.alias("expected"),
        (expected - F.col("observed")).alias("missing"), (expected > F.col("observed")).alias("has_gaps"),
    )


def inconsistent_category(df: DataFrame, product: str, category: str) -> DataFrame:
    """Products with more than one category. Distinct pairs first, so the list is as short as the categories."""
    pairs = df.where(F.col(category).isNotNull()).select(product, category).distinct()
    return (
        pairs.groupBy(product)
        .agg(one().alias("n_categories"), F.array_join(F.array_sort(F.collect_set(category)), ", ").alias("categories"))
        .where("n_categories > 1")
    )


def yearly_summary(df: DataFrame, product: str, date: str, qty: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(
        one().alias("rows"), F.countDistinct(product).alias("products"), F.sum(qty).alias("total"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"),
    )


def gap_report(full: DataFrame, product: str, date: str, qty: str, special: list[str] = ("12-31", "02-29")) -> DataFrame:
    """Null and total days per product of a densified year, with one column per special day."""
    null = F.col(qty).isNull()
    day = D.month_day(date)
    pivots = [
        F.max(F.when(day == md, null.cast("int"))).alias("null_" + md.replace("-", "_")) for md in special
    ]
    return full.groupBy(product).agg(count_if(null).alias("null_days"), one().alias("total_days"), *pivots)


def missing_on_date(df: DataFrame, product: str, date: str, day: str) -> DataFrame:
    """Products without a row on the day, in one grouped pass."""
    hit = F.max((F.col(date) == F.lit(day).cast("date")).cast("int"))
    return df.groupBy(product).agg(hit.alias("_hit")).where("coalesce(_hit, 0) = 0").select(product)


def audit_before_after(before: DataFrame, after: DataFrame, keys: list[str], qty: str) -> DataFrame:
    """One row: sizes before and after, nulls left and repeated keys left."""
    n = before.agg(one().alias("n"))
    dup = after.groupBy(*keys).agg(one().alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("d"))
    out = after.agg(one().alias("rows_after"), count_if(F.col(qty).isNull()).alias("nulls_after"))
    return out.select(
        n.scalar().alias("rows_before"), "rows_after", (n.scalar() - F.col("rows_after")).alias("removed"),
        "nulls_after", dup.scalar().alias("duplicate_keys"),
    )


def dataset_quality_report(df: DataFrame, product: str, date: str, target: str, cluster: str) -> DataFrame:
    """One row of counts and flags over the modelling table, by a per-key, a per-product and a global step."""
    y = F.col(target)
    per_key = df.groupBy(product, date).agg(
        one().alias("n"), count_if(y.isNull()).alias("nulls"), count_if(y < 0).alias("negatives"),
        F.min(y).alias("lo"), F.max(y).alias("hi"), count_if(F.col(cluster).isNotNull()).alias("with_cluster"),
    )
    per_product = per_key.groupBy(product).agg(
        F.sum("n").alias("n"), one().alias("days"), F.sum("nulls").alias("nulls"), F.sum("negatives").alias("negatives"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("with_cluster").alias("with_cluster"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("span"),
    )
    total = per_product.agg(
        F.sum("n").alias("rows"), one().alias("products"), F.sum("nulls").alias("target_nulls"),
        F.sum("negatives").alias("target_negatives"), (F.sum("n") - F.sum("days")).alias("duplicates"),
        (100 * F.sum("days") / F.sum("span")).alias("completeness_pct"),
        count_if(F.col("lo") == F.col("hi")).alias("constant_products"),
        (100 * F.sum("with_cluster") / F.sum("n")).alias("cluster_pct"),
    )
    ok = (F.col("target_nulls") == 0) & (F.col("target_negatives") == 0) & (F.col("duplicates") == 0)
    return total.withColumn("ok_target", ok).withColumn("ok_cluster", F.col("cluster_pct") == 100)


def cluster_outlier_audit(df: DataFrame, cluster_a: str, cluster_b: str, flag: str) -> DataFrame:
    hit = F.coalesce(F.col(flag), F.lit(0)) == 1
    return df.groupBy(cluster_a).agg(
        one().alias("rows"),
        count_if(~hit & F.col(cluster_a).eqNullSafe(F.col(cluster_b))).alias("agree"),
        count_if(~hit).alias("normal"),
        count_if(hit).alias("outliers"),
    )


def cluster_profile_stats(df: DataFrame, cluster: str, product: str, cols: list[str]) -> DataFrame:
    """Mean, std, min, max and exact median of each feature. A cluster may hold most products, so the
    medians come from distributed quantiles and not from one aggregation buffer. The features are written
    once, and the medians of all of them are one set of quantiles per (cluster, feature)."""
    df = written(df.select(cluster, product, *cols))
    aggs = [one().alias("rows"), F.countDistinct(product).alias("products")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    long = df.select(cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_p"))
    medians = exact_quantiles(long.select(cluster, F.col("_p.f").alias("_f"), F.col("_p.v").alias("_x")), [cluster, "_f"], "_x", {"_median": 0.5})
    wide = medians.groupBy(cluster).agg(*[F.max(F.when(F.col("_f") == c, F.col("_median"))).alias(f"{c}_median") for c in cols])
    return df.groupBy(cluster).agg(*aggs).join(wide, cluster, "left")


def category_cluster_pivot(df: DataFrame, category: str, cluster: str, clusters: list[int], product: str | None = None) -> DataFrame:
    """Category by cluster counts of rows, or of distinct products when ``product`` is given."""
    base = df.select(category, cluster, product).distinct() if product else df
    return base.groupBy(category).agg(*[count_if(F.col(cluster) == k).alias(f"c{k}") for k in clusters])


def mode_per_product(df: DataFrame, product: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie: counts first, then one ``min_by`` per key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(product, value).agg(one().alias("_n"))
    return counts.groupBy(product).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def catalog_meta_rollup(df: DataFrame, product: str, cluster: str, flag: str, price: str) -> DataFrame:
    meta = df.groupBy(product).agg(F.max(flag).alias(flag), F.avg(price).alias("mean_price"))
    return meta.join(mode_per_product(df, product, cluster), product, "left")


def supplier_offer_agg(df: DataFrame, product: str, supplier: str, stock: str, price: str) -> DataFrame:
    return df.groupBy(product, supplier).agg(F.sum(stock).alias("availability"), F.avg(price).alias("price"))


def monthly_mean(daily: DataFrame, date: str, total: str) -> DataFrame:
    return daily.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg(total).alias("mean_total"))


def monthly_mean_cv(daily: DataFrame, date: str, total: str, years: list[int]) -> DataFrame:
    """Mean daily total of each month by year, and its coefficient of variation over the years."""
    m = monthly_mean(daily.where(F.year(date).isin(*years)), date, total)
    wide = m.groupBy("month").agg(
        *[F.max(F.when(F.col("year") == y, F.col("mean_total"))).alias(f"y{y}") for y in years],
        (F.stddev_samp("mean_total") / F.avg("mean_total")).alias("cv"),
    )
    return wide.withColumn("stable", F.col("cv") <= 0.15)


def share_of_stable_months(wide: DataFrame) -> DataFrame:
    return wide.agg((100 * F.avg(F.col("stable").cast("double"))).alias("stable_pct"), F.avg("cv").alias("mean_cv"))


def align_by_mmdd(daily: DataFrame, date: str, total: str, years: list[int]) -> DataFrame:
    """One row per month-day with one column per year; 02-29 is left out."""
    mmdd = D.month_day(date)
    return (
        daily.where(mmdd != "02-29").groupBy(mmdd.alias("mmdd"))
        .agg(*[F.sum(F.when(F.year(date) == y, F.col(total))).alias(f"y{y}") for y in years])
    )


def supplier_rank(df: DataFrame, supplier: str, date: str, qty: str, first: str, last: str) -> DataFrame:
    inside = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.groupBy(supplier).agg(F.sum(qty).alias("units"))


def supplier_series(df: DataFrame, supplier: str, date: str, qty: str, first: str, last: str) -> DataFrame:
    inside = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.groupBy(F.trunc(date, "MM").alias("month"), supplier).agg(F.sum(qty).alias("units"))


def half_up(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def category_coverage_pct(catalog: DataFrame, subs: DataFrame, product: str, category: str) -> DataFrame:
    has = subs.select(product).distinct().withColumn("_has", F.lit(1))
    return (
        catalog.join(has, product, "left").groupBy(category)
        .agg(one().alias("products"), F.count("_has").alias("with_substitutes"))
        .withColumn("coverage_pct", half_up(100 * F.col("with_substitutes") / F.col("products"), 1))
    )


def category_mismatch_summary(df: DataFrame, valid: DataFrame, category: str, product: str, qty: str) -> DataFrame:
    """Categories outside the valid list with their products and demand, and the share of the totals."""
    totals = df.agg(F.struct(F.countDistinct(product).alias("p"), F.sum(qty).alias("q")).alias("t")).scalar()
    bad = df.join(valid.select(category).distinct(), category, "left_anti")
    out = bad.groupBy(category).agg(F.countDistinct(product).alias("products"), F.sum(qty).alias("demand")).withColumn("_t", totals)
    return out.select(
        category, "products", "demand",
        (100 * F.col("products") / F.col("_t.p")).alias("products_pct"), (100 * F.col("demand") / F.col("_t.q")).alias("demand_pct"),
    )


def supplier_criticality_rank(df: DataFrame, supplier: str) -> DataFrame:
    """Counts of critical products per supplier and the position in the four-key order."""
    agg = df.groupBy(supplier).agg(
        count_if(F.col("broken")).alias("broken"), count_if(F.col("below_rop")).alias("below_rop"),
        count_if(F.col("below_ss")).alias("below_ss"), one().alias("total"),
    )
    return agg.orderBy(F.desc("broken"), F.desc("below_rop"), F.desc("below_ss"), "total", supplier)


def on_the_way_by_product(stores: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Open lines with their headers from several stores: pending quantity and earliest arrival."""
    parts = [
        lines.join(heads, "order_id").groupBy("product_id").agg(F.sum("qty").alias("qty"), F.min("eta_days").alias("eta_min"))
        for heads, lines in stores
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("product_id").agg(F.sum("qty").alias("qty"), F.min("eta_min").alias("eta_min"))


def top_sales_any(df: DataFrame, product: str, flag: str) -> DataFrame:
    """OR of a flag that comes as a number or as text."""
    text = F.lower(F.trim(F.col(flag).cast("string")))
    # Words read as true.
    yes = (F.coalesce(text.try_cast("double"), F.lit(0.0)) > 0) | text.isin("true", "t", "yes", "y", "si", "sí", "x")
    return df.groupBy(product).agg(F.max(F.coalesce(yes, F.lit(False))).alias("top_sales"))


def substitutes_summary(subs: DataFrame, product: str, substitute: str, shown: int = 3) -> DataFrame:
    """Distinct substitutes and the first ids in order. Only the shown ids are ever collected."""
    from pyspark.sql import Window

    pairs = subs.where(F.col(substitute).isNotNull()).select(product, substitute).distinct()
    counts = pairs.groupBy(product).agg(one().alias("subs_count"))
    rn = F.row_number().over(Window.partitionBy(product).orderBy(substitute))
    first = pairs.withColumn("_rn", rn).where(F.col("_rn") <= shown)
    ids = first.groupBy(product).agg(F.array_sort(F.collect_list(substitute)).alias("_ids"))
    text = F.array_join(F.transform("_ids", lambda x: x.cast("string")), ", ")
    return counts.join(ids, product).select(product, "subs_count", text.alias("subs_ids"))


def substitute_counts(offers: DataFrame, subs: DataFrame, product: str, supplier: str, substitute: str) -> DataFrame:
    inner = offers.groupBy(product).agg(F.greatest(F.countDistinct(supplier) - 1, F.lit(0)).alias("internal"))
    outer = subs.groupBy(product).agg(F.countDistinct(substitute).alias("external"))
    zero = F.lit(0).cast("long")
    return inner.join(outer, product, "full").select(
        product, F.coalesce("internal", zero).alias("internal"), F.coalesce("external", zero).alias("external")
    )


def purchase_order_headers(lines: DataFrame, supplier: str = "supplier") -> DataFrame:
    """Line count and amount per order and supplier; a missing supplier keeps its own header."""
    return lines.groupBy("order_id", supplier).agg(one().alias("n_lines"), F.sum("amount").alias("amount"))


def global_total_row(df: DataFrame, group: str, value: str, label: str = "TOTAL") -> DataFrame:
    """Group totals and a grand total, told apart by ``grouping`` so that a null group stays itself."""
    g = F.col(group).cast("string").alias(group)
    return (
        df.select(g, value).rollup(group)
        .agg(F.sum(value).alias("total"), one().alias("rows"), F.grouping(group).alias("_g"))
        .select(F.when(F.col("_g") == 1, label).otherwise(F.col(group)).alias(group), "total", "rows")
    )


def month_product_share(df: DataFrame, date: str, qty: str) -> DataFrame:
    """Month total over the grand total."""
    m = written(df.groupBy(F.month(date).alias("month")).agg(F.sum(qty).alias("total_month")))
    return m.withColumn("factor", F.col("total_month") / m.agg(F.sum("total_month")).scalar())


def distinct_category_list(df: DataFrame, category: str) -> DataFrame:
    return df.select(category).distinct().orderBy(category)


def category_list_summary(df: DataFrame, category: str) -> DataFrame:
    return df.select(category).distinct().agg(one().alias("n"), F.max((F.col(category) == "Otros").cast("int")).alias("has_otros"))


def min_lead_time(offers: DataFrame, product: str, lead_time: str) -> DataFrame:
    return offers.groupBy(product).agg(F.min(lead_time).alias(lead_time))
