"""Queries over joins, aggregations, series windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import aggregates as A
from stockloom.operators import calendar as cal
from stockloom.operators import joins as J
from stockloom.operators import outliers as O
from stockloom.operators import sets as U
from stockloom.operators import windows as W
from stockloom.plans.bindings import CTES
from stockloom.plans.q_cleaning import dirty, flagged, flagged_keys
from stockloom.plans.registry import query

PREF_STOCK = "availability DESC NULLS LAST, lead_time NULLS LAST, price NULLS LAST, priority NULLS LAST, supplier_id"
PREF_PRIORITY = "priority NULLS LAST, price NULLS LAST, lead_time NULLS LAST, availability DESC NULLS LAST, supplier_id"
CTES["pref_stock"] = (
    "offers",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {PREF_STOCK}) AS rn FROM offers) WHERE rn = 1",
)
CTES["pref_priority"] = (
    "offers",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {PREF_PRIORITY}) AS rn FROM offers) WHERE rn = 1",
)
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]

# ---- joins ---------------------------------------------------------------------------------------


@query(
    "enrich_mean_price_join",
    """SELECT d.*, m.mean_price FROM demand d LEFT JOIN (SELECT product_id, avg(price) AS mean_price FROM catalog GROUP BY product_id) m USING (product_id)""",
    ctes="demand catalog",
    doubles="qty mean_price",
)
def _(t):
    return J.enrich_mean_price_join(t.demand, t.catalog, "product_id", "price")


@query("assign_clusters_join", "SELECT d.*, l.cluster_id FROM demand d JOIN lookup l USING (product_id)", ctes="demand lookup", doubles="qty")
def _(t):
    return J.assign_clusters_join(t.demand, t.lookup, "product_id", "cluster_id")


@query(
    "products_without_cluster",
    """SELECT product_id, count(*) AS rows, 'sin_cluster' AS reason FROM demand
       WHERE product_id NOT IN (SELECT product_id FROM lookup) GROUP BY product_id""",
    ctes="demand lookup",
)
def _(t):
    return J.products_without_cluster(t.demand, t.lookup, "product_id", "cluster_id")


@query(
    "anti_join_products",
    """SELECT 'kept' AS part, product_id FROM catalog WHERE product_id IN (SELECT product_id FROM lookup)
       UNION ALL SELECT 'removed', product_id FROM catalog WHERE product_id NOT IN (SELECT product_id FROM lookup)""",
    ctes="catalog lookup",
)
def _(t):
    listed = t.catalog.where("pack_size > 45")
    kept, removed = J.anti_join_products(t.catalog, listed, "product_id")
    a = kept.select(F.lit("kept").alias("part"), "product_id")
    return a.unionByName(removed.select(F.lit("removed").alias("part"), "product_id"))


@query(
    "catalog_split_semi_anti",
    """SELECT CASE WHEN pack_size = 1 THEN NULL ELSE product_id END AS pid, name,
       CASE WHEN pack_size = 1 THEN 'new' WHEN product_id IN (SELECT product_id FROM sales WHERE flag = 'R') THEN 'final' ELSE 'discarded' END AS part FROM catalog""",
    ctes="catalog sales",
)
def _(t):
    c = t.catalog.select(F.when(F.col("pack_size") != 1, F.col("product_id")).alias("pid"), "name")
    sold = t.sales.where("flag = 'R'").select(F.col("product_id").alias("pid"))
    return J.catalog_split(c, sold, "pid")


@query(
    "internal_alternatives_join",
    """SELECT o.product_id, o.supplier_id, o.price, p.supplier_id AS pref_supplier_id, p.price AS pref_price
       FROM offers o JOIN pref_stock p ON o.product_id = p.product_id AND o.supplier_id <> p.supplier_id""",
    ctes="offers pref_stock",
    doubles="price pref_price",
)
def _(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    j = J.internal_alternatives_join(t.offers, pref, "product_id", "supplier_id")
    return j.select("product_id", "supplier_id", "price", "pref_supplier_id", "pref_price")


@query(
    "calendar_cross_densify",
    """SELECT p.product_id, CAST(d.day AS DATE) AS date, x.qty FROM (SELECT DISTINCT product_id FROM demand) p
       CROSS JOIN (SELECT unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS day) d
       LEFT JOIN demand x ON x.product_id = p.product_id AND x.date = CAST(d.day AS DATE)""",
    ctes="demand",
    doubles="qty",
)
def _(t):
    return cal.calendar_densify(t.demand, "product_id", "date", 2000)


@query(
    "zero_fill_universe",
    """SELECT c.product_id, coalesce(q, 0.0) AS qty FROM catalog c LEFT JOIN (SELECT product_id, sum(qty) AS q FROM sales
       GROUP BY product_id) USING (product_id)""",
    ctes="catalog sales",
    doubles="qty",
)
def _(t):
    return J.zero_fill_universe(t.catalog, t.sales, "product_id", "qty")


@query(
    "outlier_calendar_join",
    """SELECT k.product_id, k.date, e.events, e.events IS NOT NULL AS justified FROM flagged_keys k
       LEFT JOIN (SELECT date, string_agg(DISTINCT event, '; ' ORDER BY event) AS events FROM real_events GROUP BY date) e USING (date)""",
    ctes="flagged_keys real_events",
)
def _(t):
    return J.outlier_calendar_join(flagged_keys(t), t.real_events)


CTES["kinds"] = (
    "sales",
    """SELECT product_id, CAST(year(date) AS INTEGER) AS year, CASE WHEN sum(qty) > 150 THEN 'top_venta' ELSE 'mixto' END AS kind
       FROM sales GROUP BY product_id, year(date) HAVING sum(qty) > 120""",
)


def kinds(t):
    g = t.sales.groupBy("product_id", F.year("date").alias("year")).agg(F.sum("qty").alias("q")).where("q > 120")
    return g.select("product_id", "year", F.when(F.col("q") > 150, "top_venta").otherwise("mixto").alias("kind"))


@query(
    "tag_product_year",
    """SELECT d.product_id, d.date, d.qty, CAST(year(d.date) AS INTEGER) AS year, coalesce(k.kind, 'none') AS kind FROM demand d
       LEFT JOIN kinds k ON k.product_id = d.product_id AND k.year = year(d.date)""",
    ctes="demand kinds",
    doubles="qty",
)
def _(t):
    return J.tag_product_year(t.demand, kinds(t), "product_id", "date", ["kind"])


@query(
    "product_master_outer_join",
    """SELECT coalesce(c.product_id, s.product_id) AS product_id, c.name, s.map_supplier
       FROM catalog c FULL JOIN
       (SELECT product_id, arg_min('P' || supplier_id, supplier_id) AS map_supplier FROM offers GROUP BY product_id) s
       ON c.product_id = s.product_id""",
    ctes="catalog offers",
)
def _(t):
    sup = t.offers.select(
        "product_id", "supplier_id", F.concat(F.lit("P"), F.col("supplier_id").cast("string")).alias("supplier")
    )
    c = t.catalog.select("product_id", "name")
    return J.product_master_outer_join(c, sup, "product_id", "supplier_id")


@query(
    "price_map_coalesce",
    """SELECT coalesce(c.product_id, p.product_id) AS product_id, coalesce(p.price, c.price) AS price
       FROM (SELECT product_id, avg(price) AS price FROM catalog GROUP BY product_id) c FULL JOIN
       pref_stock p ON c.product_id = p.product_id""",
    ctes="catalog pref_stock",
    doubles="price",
)
def _(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    return J.price_map_coalesce(pref, t.catalog, "product_id")


CTES["m_product"] = ("flagged_keys", "SELECT product_id, date, 1.3::DOUBLE AS m FROM flagged_keys")
CTES["m_cluster"] = (
    "demand_clustered",
    "SELECT cluster_id, date, 1 + cluster_id / 10.0::DOUBLE AS m FROM demand_clustered WHERE month(date) = 11 GROUP BY ALL",
)


@query(
    "price_multiplier_priority_join",
    """SELECT d.product_id, d.date, d.cluster_id, coalesce(p.m, c.m, 1.0) AS multiplier FROM demand_clustered d
       LEFT JOIN m_product p ON p.product_id = d.product_id AND p.date = d.date
       LEFT JOIN m_cluster c ON c.cluster_id = d.cluster_id AND c.date = d.date""",
    ctes="demand_clustered m_product m_cluster",
    doubles="multiplier",
)
def _(t):
    p = flagged_keys(t).withColumn("m", F.lit(1.3))
    c = t.demand_clustered.where(F.month("date") == 11).select("cluster_id", "date").distinct()
    c = c.withColumn("m", 1 + F.col("cluster_id") / 10)
    d = t.demand_clustered.select("product_id", "date", "cluster_id")
    return J.price_multiplier_priority_join(d, p, c, "product_id", "cluster_id", "date")


@query(
    "affected_days_metrics_join",
    """SELECT count(*) AS rows, sum(is_outlier)::BIGINT AS rows_affected, count(DISTINCT product_id) AS products,
       count(DISTINCT product_id) FILTER (is_outlier = 1) AS products_affected, 100.0 * sum(is_outlier) / count(*) AS rows_pct,
       100.0 * count(DISTINCT product_id) FILTER (is_outlier = 1) / count(DISTINCT product_id) AS products_pct,
       100.0 * sum(qty) FILTER (is_outlier = 1) / sum(qty) AS sales_pct FROM flagged""",
    ctes="flagged",
    doubles="rows_pct products_pct sales_pct",
)
def _(t):
    return J.affected_days_metrics_join(t.demand, flagged_keys(t), "product_id", "date", "qty")


@query(
    "event_window_range_join",
    'SELECT d.date, d.total, w.event, w.year FROM daily_total d JOIN event_windows w ON d.date BETWEEN w.start AND w."end"',
    ctes="daily_total event_windows",
    doubles="total",
)
def _(t):
    return J.event_window_range_join(t.daily_total, t.event_windows).select("date", "total", "event", "year")


CTES["scoped_windows"] = (
    "event_windows",
    """SELECT event || '_' || year AS id, start, "end", CASE WHEN event = 'Agosto' THEN 'global' WHEN event = 'Navidad' THEN 'product_id'
       WHEN event = 'Prime Day' THEN 'other' ELSE 'cluster' END AS scope_type,
       CASE WHEN event = 'Navidad' THEN '1|6|999999999' WHEN event = 'Black Friday' THEN '1|2' WHEN event = 'Rebajas Verano' THEN '0,3' ELSE '' END AS scope_values
       FROM event_windows""",
)


def scoped_windows(t):
    e = F.col("event")
    kind = (
        F.when(e == "Agosto", "global").when(e == "Navidad", "product_id").when(e == "Prime Day", "other").otherwise("cluster")
    )
    scope = F.when(e == "Navidad", "1|6|999999999").when(e == "Black Friday", "1|2").when(e == "Rebajas Verano", "0,3").otherwise("")
    return t.event_windows.select(
        F.concat_ws("_", "event", F.col("year").cast("string")).alias("id"), "start", "end",
        kind.alias("scope_type"), scope.alias("scope_values"),
    )


CTES["joined_windows"] = (
    "scoped_windows catalog",
    """SELECT id, scope_type, start, "end", cluster_id FROM (
         SELECT id, scope_type, start, "end", unnest(CASE WHEN scope_values = '1|2' THEN [1, 2] WHEN scope_values = '0,3' THEN [0, 3] ELSE [0, 1, 2, 3] END) AS cluster_id
         FROM scoped_windows WHERE scope_type <> 'product_id'
         UNION ALL SELECT DISTINCT w.id, w.scope_type, w.start, w."end", c.cluster_id FROM scoped_windows w JOIN catalog c ON c.product_id IN (1, 6, 999999999)
         WHERE scope_type = 'product_id')""",
)


@query(
    "scope_window_join",
    """SELECT id, scope_type, cluster_id FROM (
         SELECT id, scope_type, unnest(CASE WHEN scope_values = '1|2' THEN [1, 2] WHEN scope_values = '0,3' THEN [0, 3] ELSE [0, 1, 2, 3] END) AS cluster_id
         FROM scoped_windows WHERE scope_type <> 'product_id'
         UNION ALL SELECT DISTINCT w.id, w.scope_type, c.cluster_id FROM scoped_windows w JOIN catalog c ON c.product_id IN (1, 6, 999999999)
         WHERE scope_type = 'product_id')""",
    ctes="scoped_windows catalog",
)
def _(t):
    out = J.scope_window_join(scoped_windows(t), [0, 1, 2, 3], t.catalog)
    return out.select("id", "scope_type", "cluster_id")


@query(
    "cohort_intersection",
    """SELECT * FROM demand WHERE product_id IN (SELECT product_id FROM demand GROUP BY product_id
       HAVING count(DISTINCT year(date)) = (SELECT count(DISTINCT year(date)) FROM demand))""",
    ctes="demand",
    doubles="qty",
)
def _(t):
    return J.cohort_intersection(t.demand, "product_id", "date")


@query(
    "enrich_external_substitutes",
    """SELECT s.product_id, s.substitute_id, s.score, c.name AS sub_name, c.category AS sub_category, c.supplier AS sub_supplier,
       q.price AS sub_price, q.lead_time AS sub_lead_time, coalesce(CAST(i.stock AS DOUBLE), q.availability) AS sub_availability,
       q.price - p.price AS delta_price, q.lead_time - p.lead_time AS delta_lead_time,
       coalesce(CAST(i.stock AS DOUBLE), q.availability) - p.availability AS delta_availability
       FROM substitutes_external s LEFT JOIN catalog c ON c.product_id = s.substitute_id LEFT JOIN pref_stock q ON q.product_id = s.substitute_id
       LEFT JOIN inventory i ON i.product_id = s.substitute_id LEFT JOIN pref_stock p ON p.product_id = s.product_id""",
    ctes="substitutes_external catalog pref_stock inventory",
    doubles="score sub_price sub_availability delta_price delta_availability",
)
def _(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    return J.enrich_external_substitutes(t.substitutes_external, t.catalog, pref, t.inventory)


@query(
    "internal_substitutes_rows",
    f"""SELECT product_id, supplier_id, price, lead_time, CAST(row_number() OVER (PARTITION BY product_id ORDER BY {PREF_PRIORITY}) AS INTEGER) AS rank
        FROM (SELECT o.* FROM offers o JOIN pref_stock p ON o.product_id = p.product_id AND o.supplier_id <> p.supplier_id)""",
    ctes="offers pref_stock",
    doubles="price",
)
def _(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    j = J.internal_alternatives_join(t.offers, pref, "product_id", "supplier_id").select(*t.offers.columns)
    return W.rank_internal(j).select("product_id", "supplier_id", "price", "lead_time", "rank")


@query(
    "catalog_enrichment_join",
    """SELECT count(*) AS rows, count(*) FILTER (category IS NULL) AS without_category, count(*) FILTER (status IS NULL) AS without_status,
       count(DISTINCT product_id) AS products FROM demand d LEFT JOIN (SELECT product_id AS pid, category, status FROM catalog) c ON d.product_id = c.pid""",
    ctes="demand catalog",
)
def _(t):
    return J.enrichment_summary(J.catalog_enrichment_join(t.demand, t.catalog, "product_id"), "product_id")


# ---- aggregations --------------------------------------------------------------------------------


@query(
    "demand_cluster_day",
    """SELECT cluster_id, date, sum(qty) AS qty, avg(w) AS w, avg(size) AS size FROM (SELECT s.date, s.qty, c.cluster_id, c.pack_size::DOUBLE AS size, s.line_no AS w
       FROM sales s JOIN catalog c USING (product_id)) GROUP BY cluster_id, date""",
    ctes="sales catalog",
    doubles="qty w size",
)
def _(t):
    df = t.sales.join(t.catalog, "product_id").withColumnsRenamed({"line_no": "w", "pack_size": "size"})
    return A.demand_cluster_day(df, "cluster_id", "date", "qty", ["w", "size"])


@query(
    "product_features",
    """SELECT d.*, c.price AS mean_price FROM (SELECT product_id, sum(qty) AS d_total, avg(qty) AS d_mean, stddev_samp(qty) AS d_std,
       quantile_cont(qty, 0.95) AS p95, median(qty) AS median, count(*) AS n, stddev_samp(qty) / avg(qty) AS cv FROM demand GROUP BY product_id) d
       LEFT JOIN catalog c USING (product_id)""",
    ctes="demand catalog",
    doubles="d_total d_mean d_std p95 median cv mean_price",
)
def _(t):
    return A.product_features(t.demand, t.catalog.select("product_id", "price"))


_FEAT_YEARS = YEARS
_GROWTH = {f"g_{b % 100:02d}_{a % 100:02d}": (a, b) for a, b in zip(_FEAT_YEARS, _FEAT_YEARS[1:])}
_M = ", ".join(f"sum(q) FILTER (month(date) = {m}) / sum(q) AS m_{m:02d}" for m in range(1, 13))
_W = ", ".join(f"sum(q) FILTER (isodow(date) = {d + 1}) / sum(q) AS dow_{d}" for d in range(7))
_Y = ", ".join(f"sum(q) FILTER (year(date) = {y}) AS y{y}" for y in _FEAT_YEARS)
_FEAT_COLS = (
    [f"m_{m:02d}" for m in range(1, 13)] + [f"dow_{d}" for d in range(7)] + [f"y{y}" for y in _FEAT_YEARS] + [*_GROWTH, "cv_daily", "p95_over_med"]
)


@query(
    "category_features",
    f"""SELECT *, {", ".join(f"coalesce(y{b} / nullif(y{a}, 0) - 1, 0) AS {g}" for g, (a, b) in _GROWTH.items())} FROM (SELECT category, {_M}, {_W}, {_Y},
        stddev_samp(q) / avg(q) AS cv_daily, quantile_cont(q, 0.95) / median(q) AS p95_over_med
        FROM (SELECT category, date, sum(qty) AS q FROM sales JOIN catalog USING (product_id) GROUP BY category, date)
        GROUP BY category)""",
    ctes="sales catalog",
    doubles=" ".join(_FEAT_COLS),
)
def _(t):
    df = t.sales.join(t.catalog.select("product_id", "category"), "product_id")
    return A.category_features(df, "category", "date", "qty", _FEAT_YEARS)


@query(
    "merge_minor_categories",
    """WITH b AS (SELECT product_id, date, qty, CASE WHEN pack_size = 9 THEN NULL ELSE brand END AS brand FROM demand JOIN catalog USING (product_id)),
         k AS (SELECT brand, sum(qty) AS t, count(DISTINCT product_id) AS p FROM b WHERE brand IS NOT NULL GROUP BY brand)
       SELECT product_id, date, qty, CASE WHEN brand IN (SELECT brand FROM k WHERE t / (SELECT sum(t) FROM k) < 0.04 OR p < (SELECT sum(p) FROM k) * 0.0395) THEN 'Otros' ELSE brand END AS brand FROM b""",
    ctes="demand catalog",
    doubles="qty",
)
def _(t):
    brand = F.when(F.col("pack_size") != 9, F.col("brand")).alias("brand")
    df = t.demand.join(t.catalog.select("product_id", brand), "product_id")
    products = df.where("brand is not null").select("product_id").distinct().count()
    return A.merge_minor_categories(df, "brand", "product_id", "qty", 0.04, products * 0.0395)


CTES["year_coverage"] = (
    "demand",
    """SELECT product_id, CAST(year(date) AS INTEGER) AS year, count(DISTINCT date) AS observed, CAST(dayofyear(make_date(year(date), 12, 31)) AS BIGINT) AS expected
       FROM demand GROUP BY product_id, year(date)""",
)


@query(
    "coverage_by_product",
    """SELECT product_id, sum(observed)::DOUBLE / sum(expected) AS overall, min(observed::DOUBLE / expected) AS per_year FROM year_coverage
       GROUP BY product_id""",
    ctes="year_coverage",
    doubles="overall per_year",
    digits=6,
)
def _(t):
    args = ("product_id", "date", "1900-01-01", "2999-12-31")  # all years
    a = A.coverage_by_product(t.demand, *args, "overall").withColumnRenamed("coverage", "overall")
    return a.join(A.coverage_by_product(t.demand, *args, "per_year").withColumnRenamed("coverage", "per_year"), "product_id")


@query(
    "coverage_by_product_year",
    "SELECT *, expected - observed AS missing, expected > observed AS has_gaps FROM year_coverage",
    ctes="year_coverage",
)
def _(t):
    return A.coverage_by_product_year(t.demand, "product_id", "date")


@query(
    "inconsistent_category",
    """SELECT product_id, count(DISTINCT flag) AS n_categories, string_agg(DISTINCT flag, ', ' ORDER BY flag) AS categories FROM sales
       GROUP BY product_id HAVING count(DISTINCT flag) > 1""",
    ctes="sales",
)
def _(t):
    return A.inconsistent_category(t.sales, "product_id", "flag")


@query(
    "yearly_summary",
    """SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT product_id) AS products, sum(qty) AS total,
       min(date) AS date_min, max(date) AS date_max FROM sales GROUP BY year(date)""",
    ctes="sales",
    doubles="total",
)
def _(t):
    return A.yearly_summary(t.sales, "product_id", "date", "qty")


CTES["full2000"] = (
    "demand",
    """SELECT p.product_id, d.date, x.qty FROM (SELECT DISTINCT product_id FROM demand) p
       CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d
       LEFT JOIN demand x ON x.product_id = p.product_id AND x.date = d.date""",
)


@query(
    "gap_report",
    """SELECT product_id, count(*) FILTER (qty IS NULL) AS null_days, count(*) AS total_days,
       max(CASE WHEN date = DATE '2000-12-31' THEN CAST(qty IS NULL AS INTEGER) END) AS null_12_31,
       max(CASE WHEN date = DATE '2000-02-29' THEN CAST(qty IS NULL AS INTEGER) END) AS null_02_29 FROM full2000 GROUP BY product_id""",
    ctes="full2000",
)
def _(t):
    return A.gap_report(cal.calendar_densify(t.demand, "product_id", "date", 2000), "product_id", "date", "qty")


@query(
    "missing_on_date",
    "SELECT DISTINCT product_id FROM sales EXCEPT SELECT product_id FROM sales WHERE date = DATE '2000-02-29'",
    ctes="sales",
)
def _(t):
    return A.missing_on_date(t.sales, "product_id", "date", "2000-02-29")


@query(
    "audit_before_after",
    """SELECT b AS rows_before, a AS rows_after, b - a AS removed, nulls AS nulls_after, CAST(d AS BIGINT) AS duplicate_keys FROM
       (SELECT count(*) AS b FROM dirty), (SELECT count(*) AS a, count(*) FILTER (qty IS NULL) AS nulls FROM dirty WHERE category IS NOT NULL),
       (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM dirty WHERE category IS NOT NULL GROUP BY product_id, date))""",
    ctes="dirty",
)
def _(t):
    df = dirty(t)
    return A.audit_before_after(df, df.where("category is not null"), ["product_id", "date"], "qty")


@query(
    "dataset_quality_report",
    """SELECT rows, products, target_nulls, target_negatives, rows - days AS duplicates, 100.0 * days / span AS completeness_pct,
       constant_products, 100.0 * with_cluster / rows AS cluster_pct, target_nulls = 0 AND target_negatives = 0 AND rows = days AS ok_target,
       with_cluster = rows AS ok_cluster FROM (
       SELECT sum(n)::BIGINT AS rows, count(*) AS products, sum(nulls)::BIGINT AS target_nulls, sum(neg)::BIGINT AS target_negatives, sum(days)::BIGINT AS days,
         sum(span)::BIGINT AS span, count(*) FILTER (lo = hi) AS constant_products, sum(wc)::BIGINT AS with_cluster FROM (
           SELECT product_id, count(*) AS n, count(*) FILTER (qty IS NULL) AS nulls, count(*) FILTER (qty < 0) AS neg, count(DISTINCT coalesce(date, DATE '1900-01-01')) AS days,
             max(date) - min(date) + 1 AS span, min(qty) AS lo, max(qty) AS hi, count(category) AS wc FROM dirty GROUP BY product_id))""",
    ctes="dirty",
    doubles="completeness_pct cluster_pct",
)
def _(t):
    return A.dataset_quality_report(dirty(t), "product_id", "date", "qty", "category")


@query(
    "cluster_outlier_audit",
    """SELECT cluster_a, count(*) AS rows, count(*) FILTER (is_outlier = 0 AND cluster_a = cluster_b) AS agree, count(*) FILTER (is_outlier = 0) AS normal,
       count(*) FILTER (is_outlier = 1) AS outliers FROM (SELECT is_outlier, CAST(product_id % 4 AS INTEGER) AS cluster_a, CAST(product_id % 8 // 2 AS INTEGER) AS cluster_b FROM flagged) GROUP BY cluster_a""",
    ctes="flagged",
)
def _(t):
    a = (F.col("product_id") % 4).cast("int")
    b = F.floor((F.col("product_id") % 8) / 2).cast("int")
    df = flagged(t).select("is_outlier", a.alias("cluster_a"), b.alias("cluster_b"))
    return A.cluster_outlier_audit(df, "cluster_a", "cluster_b", "is_outlier")


_PROFILE = ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, median({c}) AS {c}_median" for c in ("d_total", "d_mean")
)
_PROFILE_COLS = " ".join(f"{c}_{s}" for c in ("d_total", "d_mean") for s in ("mean", "std", "min", "max", "median"))


@query(
    "cluster_profile_stats",
    f"""SELECT cluster_id, count(*) AS rows, count(DISTINCT product_id) AS products, {_PROFILE} FROM
        (SELECT product_id, CAST(product_id % 4 AS INTEGER) AS cluster_id, sum(qty) AS d_total, avg(qty) AS d_mean FROM demand GROUP BY product_id) GROUP BY cluster_id""",
    ctes="demand",
    doubles=_PROFILE_COLS,
)
def _(t):
    f = A.product_features(t.demand).withColumn("cluster_id", (F.col("product_id") % 4).cast("int"))
    return A.cluster_profile_stats(f, "cluster_id", "product_id", ["d_total", "d_mean"])


@query(
    "category_cluster_pivot",
    "SELECT brand, " + ", ".join(f"count(DISTINCT product_id) FILTER (cluster_id = {k}) AS c{k}" for k in range(4)) + " FROM demand_clustered JOIN (SELECT product_id, brand FROM catalog) USING (product_id) GROUP BY brand",
    ctes="demand_clustered catalog",
)
def _(t):
    df = t.demand_clustered.join(t.catalog.select("product_id", "brand"), "product_id")
    return A.category_cluster_pivot(df, "brand", "cluster_id", [0, 1, 2, 3], "product_id")


CTES["supplier_mode"] = (
    "sales",
    """SELECT product_id, supplier_id FROM (SELECT product_id, supplier_id, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, supplier_id) AS rn
       FROM sales GROUP BY product_id, supplier_id) WHERE rn = 1""",
)


@query("mode_per_product", "SELECT * FROM supplier_mode", ctes="supplier_mode")
def _(t):
    return A.mode_per_product(t.sales, "product_id", "supplier_id")


@query(
    "catalog_meta_rollup",
    """SELECT m.product_id, m.is_outlier, m.mean_price, s.supplier_id FROM (SELECT product_id, max(CAST(qty >= 49 AS INTEGER)) AS is_outlier, avg(line_no::DOUBLE) AS mean_price FROM sales GROUP BY product_id) m
       LEFT JOIN supplier_mode s USING (product_id)""",
    ctes="sales supplier_mode",
    doubles="mean_price",
)
def _(t):
    df = t.sales.withColumn("is_outlier", (F.col("qty") >= 49).cast("int"))
    return A.catalog_meta_rollup(df, "product_id", "supplier_id", "is_outlier", "line_no")


@query(
    "supplier_offer_agg",
    "SELECT product_id, supplier_id, sum(qty) AS availability, avg(line_no::DOUBLE) AS price FROM sales GROUP BY product_id, supplier_id",
    ctes="sales",
    doubles="availability price",
)
def _(t):
    return A.supplier_offer_agg(t.sales, "product_id", "supplier_id", "qty", "line_no")


CTES["month_mean"] = (
    "daily_total",
    "SELECT year(date) AS year, month(date) AS month, avg(total) AS m FROM daily_total GROUP BY ALL",
)
CTES["month_wide"] = (
    "month_mean",
    f"""SELECT CAST(month AS INTEGER) AS month, {", ".join(f"max(m) FILTER (year = {y}) AS y{y}" for y in _FEAT_YEARS)},
       stddev_samp(m) / avg(m) AS cv, stddev_samp(m) / avg(m) <= 0.15 AS stable FROM month_mean GROUP BY month""",
)


@query("monthly_mean_cv", "SELECT * FROM month_wide", ctes="month_wide", doubles=" ".join(f"y{y}" for y in _FEAT_YEARS) + " cv")
def _(t):
    return A.monthly_mean_cv(t.daily_total, "date", "total", _FEAT_YEARS)


@query(
    "share_of_stable_months",
    "SELECT 100 * avg(CAST(stable AS DOUBLE)) AS stable_pct, avg(cv) AS mean_cv FROM month_wide",
    ctes="month_wide",
    doubles="stable_pct mean_cv",
)
def _(t):
    return A.share_of_stable_months(A.monthly_mean_cv(t.daily_total, "date", "total", _FEAT_YEARS))


@query(
    "align_by_mmdd",
    "SELECT strftime(date, '%m-%d') AS mmdd, " + ", ".join(f"sum(total) FILTER (year(date) = {y}) AS y{y}" for y in _FEAT_YEARS) + " FROM daily_total WHERE strftime(date, '%m-%d') <> '02-29' GROUP BY 1",
    ctes="daily_total",
    doubles=" ".join(f"y{y}" for y in _FEAT_YEARS),
)
def _(t):
    return A.align_by_mmdd(t.daily_total, "date", "total", _FEAT_YEARS)


@query(
    "supplier_rank_and_series",
    """SELECT CAST(date_trunc('month', date) AS DATE) AS month, supplier_id, sum(qty) AS units FROM sales
       WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY ALL
       UNION ALL SELECT NULL, supplier_id, sum(qty) FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY supplier_id""",
    ctes="sales",
    doubles="units",
)
def _(t):
    args = (t.sales, "supplier_id", "date", "qty", "1998-01-01", "1999-12-31")
    return A.supplier_series(*args).unionByName(A.supplier_rank(*args).withColumn("month", F.lit(None).cast("date")))


CTES["good_subs"] = ("substitutes_external", "SELECT * FROM substitutes_external WHERE score >= 0.7")


@query(
    "category_coverage_pct",
    """SELECT category, count(*) AS products, count(*) FILTER (product_id IN (SELECT product_id FROM good_subs)) AS with_substitutes,
       floor(1000.0 * count(*) FILTER (product_id IN (SELECT product_id FROM good_subs)) / count(*) + 0.5) / 10 AS coverage_pct FROM catalog GROUP BY category""",
    ctes="good_subs catalog",
    doubles="coverage_pct",
)
def _(t):
    return A.category_coverage_pct(t.catalog, t.substitutes_external.where("score >= 0.7"), "product_id", "category")


CTES["buyers"] = ("", "SELECT o_custkey AS customer_id, o_orderkey AS order_id, o_totalprice AS amount FROM orders")
CTES["visitors"] = ("", "SELECT DISTINCT user_id AS customer_id FROM events")


def buyers(t):
    return t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"))


def visitors(t):
    return t.source("events").select(F.col("user_id").alias("customer_id"))


@query(
    "category_mismatch_summary",
    """SELECT customer_id, count(DISTINCT order_id) AS products, sum(amount) AS demand,
       100.0 * count(DISTINCT order_id) / (SELECT count(DISTINCT order_id) FROM buyers) AS products_pct, 100 * sum(amount) / (SELECT sum(amount) FROM buyers) AS demand_pct
       FROM buyers WHERE customer_id NOT IN (SELECT customer_id FROM visitors) GROUP BY customer_id""",
    ctes="buyers visitors",
    doubles="demand products_pct demand_pct",
)
def _(t):
    """Orders of the customers who are in no event."""
    return A.category_mismatch_summary(buyers(t), visitors(t), "customer_id", "order_id", "amount")


@query(
    "supplier_criticality_rank",
    """SELECT supplier, count(*) FILTER (s < 200) AS broken, count(*) FILTER (s < 500) AS below_rop, count(*) FILTER (s < 300) AS below_ss, count(*) AS total
       FROM (SELECT supplier, stock AS s FROM inventory) GROUP BY supplier""",
    ctes="inventory",
)
def _(t):
    df = t.inventory.select(
        "supplier", (F.col("stock") < 200).alias("broken"), (F.col("stock") < 500).alias("below_rop"), (F.col("stock") < 300).alias("below_ss")
    )
    return A.supplier_criticality_rank(df, "supplier")


CTES["otw"] = (
    "",
    """SELECT product_id, CAST(sum(qty) AS BIGINT) AS qty, min(eta_days) AS eta_min FROM (SELECT l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty,
       CAST(1 + o_custkey % 20 AS INTEGER) AS eta_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'P')) GROUP BY product_id""",
)


def open_stores(t):
    """Open orders of two states, as two stores of headers and lines."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("qty"))
    stores = []
    for state in ("O", "P"):
        heads = t.orders.where(F.col("o_orderstatus") == state).select(
            F.col("o_orderkey").alias("order_id"), (1 + F.col("o_custkey") % 20).cast("int").alias("eta_days")
        )
        stores.append((heads, lines))
    return stores


@query("on_the_way_by_product", "SELECT * FROM otw", ctes="otw")
def _(t):
    return A.on_the_way_by_product(open_stores(t))


CTES["top_flags"] = ("sales", "SELECT product_id, max(CAST(qty >= 50 OR (flag = 'N' AND qty >= 48) AS INTEGER)) = 1 AS top_sales FROM sales GROUP BY product_id")


def top_flags(t):
    q = F.col("qty")
    raw = F.when(q >= 50, "2").when((F.col("flag") == "N") & (q >= 48), " Sí").when(q > 20, "0").otherwise("no")
    return A.top_sales_any(t.sales.select("product_id", raw.alias("flag")), "product_id", "flag")


@query("top_sales_any", "SELECT * FROM top_flags", ctes="top_flags")
def _(t):
    return top_flags(t)


CTES["subs_summary"] = (
    "good_subs",
    """SELECT product_id, count(DISTINCT substitute_id) AS subs_count, array_to_string(list_transform(list_sort(list(DISTINCT substitute_id))[1:3], lambda x: CAST(x AS VARCHAR)), ', ') AS subs_ids
       FROM good_subs GROUP BY product_id""",
)


@query("substitutes_summary", "SELECT * FROM subs_summary", ctes="subs_summary")
def _(t):
    return A.substitutes_summary(t.substitutes_external.where("score >= 0.7"), "product_id", "substitute_id")


@query(
    "substitute_counts",
    """SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(i, 0) AS internal, coalesce(e, 0) AS external FROM
       (SELECT product_id, greatest(count(DISTINCT supplier_id) - 1, 0) AS i FROM offers GROUP BY product_id) a FULL JOIN
       (SELECT product_id, count(DISTINCT substitute_id) AS e FROM good_subs GROUP BY product_id) b ON a.product_id = b.product_id""",
    ctes="offers good_subs",
)
def _(t):
    return A.substitute_counts(t.offers, t.substitutes_external.where("score >= 0.7"), "product_id", "supplier_id", "substitute_id")


@query(
    "purchase_order_headers",
    """SELECT order_id, supplier, count(*) AS n_lines, sum(amount) AS amount FROM (SELECT l_orderkey AS order_id,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS supplier, floor(l_extendedprice) AS amount FROM lineitem) GROUP BY ALL""",
    doubles="amount",
)
def _(t):
    df = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("supplier"),
        F.floor("l_extendedprice").cast("double").alias("amount"),
    )
    return A.purchase_order_headers(df)


@query(
    "global_total_row",
    "SELECT CASE WHEN grouping(g) = 1 THEN 'TOTAL' ELSE g END AS cluster_id, sum(qty) AS total, count(*) AS rows FROM (SELECT CAST(cluster_id AS VARCHAR) AS g, qty FROM demand_clustered) GROUP BY ROLLUP (g)",
    ctes="demand_clustered",
    doubles="total",
)
def _(t):
    return A.global_total_row(t.demand_clustered, "cluster_id", "qty")


@query(
    "month_product_share",
    "SELECT CAST(month(date) AS INTEGER) AS month, sum(qty) AS total_month, sum(qty) / (SELECT sum(qty) FROM sales) AS factor FROM sales GROUP BY month(date)",
    ctes="sales",
    doubles="total_month factor",
    digits=6,
)
def _(t):
    return A.month_product_share(t.sales, "date", "qty")


@query("distinct_category_list", "SELECT DISTINCT brand FROM catalog ORDER BY brand", ctes="catalog")
def _(t):
    return A.distinct_category_list(t.catalog, "brand")


@query("category_list_summary", "SELECT count(DISTINCT brand) AS n, max(CAST(brand = 'Otros' AS INTEGER)) AS has_otros FROM catalog", ctes="catalog")
def _(t):
    return A.category_list_summary(t.catalog, "brand")


@query("min_lead_time", "SELECT product_id, min(lead_time) AS lead_time FROM offers GROUP BY product_id", ctes="offers")
def _(t):
    return A.min_lead_time(t.offers, "product_id", "lead_time")


# ---- series windows and rankings -----------------------------------------------------------------


@query(
    "lag_features",
    "SELECT product_id, date, qty, lag(qty, 1) OVER w AS qty_lag1, lag(qty, 7) OVER w AS qty_lag7, lag(qty, 14) OVER w AS qty_lag14 FROM demand WINDOW w AS (PARTITION BY product_id ORDER BY date)",
    ctes="demand",
    doubles="qty qty_lag1 qty_lag7 qty_lag14",
)
def _(t):
    return W.lag_features(t.demand, ["product_id"], "date", ["qty"], [1, 7, 14])


_ROLL = ", ".join(
    f"CASE WHEN count(x) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {m} THEN avg(x) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS x_roll{n}"
    for n, m in ((7, 5), (28, 17))
)


@query(
    "rolling_mean_shifted",
    f"SELECT product_id, date, x, {_ROLL} FROM (SELECT product_id, date, CASE WHEN qty > 45 THEN NULL ELSE qty END AS x FROM demand)",
    ctes="demand",
    doubles="x x_roll7 x_roll28",
)
def _(t):
    df = t.demand.select("product_id", "date", F.when(F.col("qty") <= 45, F.col("qty")).alias("x"))
    return W.rolling_mean_shifted(df, ["product_id"], "date", ["x"], [7, 28])


@query(
    "centered_rolling_mean",
    "SELECT cluster_id, date, qty, avg(qty) OVER (PARTITION BY cluster_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS qty_smooth FROM cluster_days",
    ctes="cluster_days",
    doubles="qty qty_smooth",
)
def _(t):
    return W.centered_rolling_mean(t.cluster_days, ["cluster_id"], "date", "qty")


@query("preferred_supplier_stock_first", "SELECT * FROM pref_stock", ctes="pref_stock", doubles="price availability")
def _(t):
    return W.preferred_supplier_stock_first(t.offers)


@query("preferred_supplier_priority_first", "SELECT * FROM pref_priority", ctes="pref_priority", doubles="price availability")
def _(t):
    return W.preferred_supplier_priority_first(t.offers)


@query(
    "repair_single_preferred",
    """SELECT o.product_id, o.supplier_id, o.price, CAST(CASE WHEN n = 1 THEN o.priority WHEN o.supplier_id = b.supplier_id THEN 1 ELSE 2 END AS INTEGER) AS priority
       FROM offers o JOIN (SELECT product_id, count(*) FILTER (priority = 1) AS n FROM offers GROUP BY product_id) c USING (product_id) JOIN pref_priority b ON b.product_id = o.product_id""",
    ctes="offers pref_priority",
    doubles="price",
)
def _(t):
    return W.repair_single_preferred(t.offers).select("product_id", "supplier_id", "price", "priority")


@query(
    "rank_internal",
    f"SELECT product_id, supplier_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY {PREF_PRIORITY}) AS INTEGER) AS rank FROM offers",
    ctes="offers",
)
def _(t):
    return W.rank_internal(t.offers).select("product_id", "supplier_id", "rank")


@query(
    "rank_external",
    "SELECT product_id, substitute_id, score, CAST(row_number() OVER (PARTITION BY product_id ORDER BY score DESC, substitute_id) AS INTEGER) AS rank FROM good_subs",
    ctes="good_subs",
    doubles="score",
)
def _(t):
    return W.rank_external(t.substitutes_external)


CTES["ledger_run"] = (
    "order_lines inventory",
    """SELECT o.*, stock AS stock_start, stock - CAST(sum(qty) OVER (PARTITION BY o.product_id ORDER BY order_date, order_id, line_no, supplier_id, qty ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock_after
       FROM order_lines o JOIN inventory i USING (product_id)""",
)


def ledger_run(t):
    order = ["order_date", "order_id", "line_no", "supplier_id", "qty"]
    return W.running_stock_ledger(t.order_lines, t.inventory, "product_id", "order_date", order, "qty", "stock")


@query(
    "running_stock_ledger",
    "SELECT product_id, order_date, order_id, line_no, supplier_id, qty, 'venta' AS movement, stock_after FROM ledger_run",
    ctes="ledger_run",
)
def _(t):
    return ledger_run(t)


CTES["importance"] = ("demand_clustered", "SELECT cluster_id, CAST(month(date) AS INTEGER) AS feature, sum(qty) AS value FROM demand_clustered GROUP BY ALL")


@query(
    "normalize_importance_by_group",
    "SELECT cluster_id, feature, 100 * value / sum(value) OVER (PARTITION BY cluster_id) AS value FROM importance",
    ctes="importance",
    doubles="value",
)
def _(t):
    df = t.demand_clustered.groupBy("cluster_id", F.month("date").alias("feature")).agg(F.sum("qty").alias("value"))
    return W.normalize_importance_by_group(df, "cluster_id", "value")


@query(
    "best_model_per_cluster",
    "SELECT cluster_id, model, year, wape FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY wape NULLS LAST, model) AS rn FROM metrics) WHERE rn = 1",
    ctes="metrics",
    doubles="wape",
)
def _(t):
    return W.best_model_per_cluster(t.metrics, "cluster_id", "wape", "model").select("cluster_id", "model", "year", "wape")


@query(
    "gaps_and_islands",
    """SELECT cluster_id, min(date) AS start, max(date) AS "end" FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY date) AS INTEGER) AS k
       FROM cluster_days WHERE qty > (SELECT quantile_cont(qty, 0.9) FROM cluster_days)) GROUP BY cluster_id, k""",
    ctes="cluster_days",
)
def _(t):
    high = t.cluster_days.agg(F.percentile("qty", 0.9)).scalar()
    return cal.gaps_and_islands(t.cluster_days.where(F.col("qty") > high), ["cluster_id"])


@query(
    "highest_lift_window_wins",
    """SELECT date, cluster_id, id, m FROM (SELECT *, row_number() OVER (PARTITION BY date, cluster_id ORDER BY abs(m - 1) DESC, id) AS rn FROM (
         SELECT CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS date, id, cluster_id, 1 + (length(id) % 5 - 2) / 10 AS m FROM joined_windows)) WHERE rn = 1""",
    ctes="joined_windows",
    doubles="m",
)
def _(t):
    days = cal.expand_windows_daily(J.scope_window_join(scoped_windows(t), [0, 1, 2, 3], t.catalog)).withColumn("m", 1 + (F.length("id") % 5 - 2) / 10)
    return W.highest_lift_window_wins(days.select("date", "cluster_id", "id", "m"), ["date", "cluster_id"])


@query(
    "latest_row_per_key",
    "SELECT product_id, date, qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM demand) WHERE rn = 1",
    ctes="demand",
    doubles="qty",
)
def _(t):
    return W.latest_row_per_key(t.demand, ["product_id"], "date")


@query(
    "z_scale_per_cluster",
    """SELECT cluster_id, date, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS x FROM (
         SELECT cluster_id, date, CASE WHEN qty > (SELECT quantile_cont(qty, 0.9) FROM cluster_days) THEN 0 ELSE qty END AS x FROM cluster_days) WINDOW w AS (PARTITION BY cluster_id)""",
    ctes="cluster_days",
    doubles="x",
)
def _(t):
    high = t.cluster_days.agg(F.percentile("qty", 0.9)).scalar()
    df = t.cluster_days.select("cluster_id", "date", F.when(F.col("qty") <= high, F.col("qty")).alias("x"))
    return W.z_scale_per_cluster(df, "cluster_id", ["x"])


@query(
    "forward_fill_exog",
    """SELECT product_id, date, coalesce(last_value(x IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       first_value(x IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS x
       FROM (SELECT product_id, date, CASE WHEN qty > 25 THEN NULL ELSE qty END AS x FROM demand) WINDOW w AS (PARTITION BY product_id ORDER BY date)""",
    ctes="demand",
    doubles="x",
)
def _(t):
    df = t.demand.select("product_id", "date", F.when(F.col("qty") <= 25, F.col("qty")).alias("x"))
    return W.forward_fill_exog(df, ["product_id"], "date", ["x"])


@query(
    "cheapest_supplier",
    "SELECT product_id, supplier_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price NULLS LAST, supplier_id) AS rn FROM offers) WHERE rn = 1",
    ctes="offers",
    doubles="price",
)
def _(t):
    return W.cheapest_supplier(t.offers).select("product_id", "supplier_id", "price")


# ---- set operations ------------------------------------------------------------------------------


@query(
    "union_years",
    "SELECT product_id, date, qty, 'demanda_' || year(date) AS source FROM demand WHERE year(date) BETWEEN 1995 AND 2001",
    ctes="demand",
    doubles="qty",
)
def _(t):
    return U.union_years({f"demanda_{y}": t.demand.where(F.year("date") == y) for y in YEARS})


CTES["unified_subs"] = (
    "offers pref_stock substitutes_external",
    """SELECT o.product_id, 'interno' AS kind, NULL::BIGINT AS substitute_id, o.supplier_id, NULL::DOUBLE AS score, o.price, o.availability, o.lead_time, o.priority
       FROM offers o JOIN pref_stock p ON o.product_id = p.product_id AND o.supplier_id <> p.supplier_id
       UNION SELECT product_id, 'externo', substitute_id, NULL, score, NULL, NULL, NULL, NULL FROM substitutes_external WHERE product_id <> substitute_id""",
)


def unified_subs(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    inner = J.internal_alternatives_join(t.offers, pref, "product_id", "supplier_id").select(*t.offers.columns)
    return U.union_substitutes(inner, t.substitutes_external)


@query("union_substitutes", "SELECT * FROM unified_subs", ctes="unified_subs", doubles="score price availability")
def _(t):
    return unified_subs(t)


@query(
    "union_distinct_days",
    "SELECT product_id, date FROM flagged_keys UNION SELECT product_id, date FROM sales WHERE flag = 'R' AND qty >= 40",
    ctes="flagged_keys sales",
)
def _(t):
    return U.union_distinct_days(flagged_keys(t), t.sales.where("flag = 'R' and qty >= 40"), ["product_id", "date"])


@query(
    "category_set_difference",
    """SELECT customer_id, 'a' AS only_in FROM (SELECT customer_id FROM buyers EXCEPT SELECT customer_id FROM visitors)
       UNION ALL SELECT customer_id, 'b' FROM (SELECT customer_id FROM visitors EXCEPT SELECT customer_id FROM buyers)""",
    ctes="buyers visitors",
)
def _(t):
    """Customers who order but are in no event, and the other way round."""
    return U.category_set_difference(buyers(t), visitors(t), "customer_id")


@query(
    "asymmetric_pairs",
    """SELECT CAST(product_id AS VARCHAR) AS product_id, CAST(substitute_id AS VARCHAR) AS substitute_id FROM good_subs a WHERE NOT EXISTS
       (SELECT 1 FROM good_subs b WHERE b.product_id = a.substitute_id AND b.substitute_id = a.product_id)""",
    ctes="good_subs",
)
def _(t):
    p = t.substitutes_external.where("score >= 0.7").select(
        "product_id", F.concat(F.col("substitute_id").cast("string"), F.lit(".0")).alias("substitute_id")
    )
    return U.asymmetric_pairs(p, "product_id", "substitute_id")


@query(
    "exact_duplicates",
    """SELECT product_id, supplier_id, flag, n FROM (SELECT product_id, supplier_id, flag, count(*) AS n FROM sales GROUP BY ALL) WHERE n > 1
       UNION ALL SELECT DISTINCT product_id, supplier_id, flag, 1 FROM sales""",
    ctes="sales",
)
def _(t):
    repeated, unique = U.exact_duplicates(t.sales.select("product_id", "supplier_id", "flag"))
    return repeated.unionByName(unique.withColumn("n", F.lit(1).cast("long")))


@query(
    "subset_containment",
    "SELECT DISTINCT product_id FROM sales WHERE year(date) = 2001 EXCEPT SELECT product_id FROM sales WHERE year(date) = 1995",
    ctes="sales",
)
def _(t):
    return U.subset_containment(t.sales.where(F.year("date") == 2001), t.sales.where(F.year("date") == 1995), "product_id")


@query(
    "ledger_union_dedup",
    "SELECT DISTINCT product_id, date, CASE WHEN flag = 'R' THEN 'devolucion' ELSE 'venta' END AS movement, qty FROM sales",
    ctes="sales",
    doubles="qty",
)
def _(t):
    m = F.when(F.col("flag") == "R", "devolucion").otherwise("venta").alias("movement")
    rows = t.sales.select("product_id", "date", m, "qty")
    return U.ledger_union_dedup(rows, rows.where("qty > 30").withColumn("date", F.col("date").cast("date")))


@query(
    "unusual_substitutes",
    """SELECT product_id, kind, substitute_id, supplier_id, 'externo_score<0.7' AS reason FROM unified_subs WHERE kind = 'externo' AND score < 0.7
       UNION ALL SELECT product_id, kind, substitute_id, supplier_id, 'interno_metricas_incoherentes' FROM unified_subs WHERE kind = 'interno' AND priority = 3""",
    ctes="unified_subs",
)
def _(t):
    df = unified_subs(t).withColumn("priority", F.when(F.col("priority") != 3, F.col("priority")))
    return U.unusual_substitutes(df).select("product_id", "kind", "substitute_id", "supplier_id", "reason")


@query(
    "union_order_sources",
    "SELECT date, product_id, CASE WHEN flag = 'R' AND qty > 40 THEN 0 ELSE qty END AS qty FROM sales",
    ctes="sales",
    doubles="qty",
)
def _(t):
    web = t.sales.where("flag <> 'R'").select(F.col("date").alias("fecha"), F.col("product_id").alias("sku"), "qty")
    shop = t.sales.where("flag = 'R'").select("date", "product_id", F.when(F.col("qty") > 40, "n/a").otherwise(F.col("qty").cast("string")).alias("units"))
    return U.union_order_sources(
        [(web, {"date": "fecha", "product_id": "sku", "qty": "qty"}), (shop, {"date": "date", "product_id": "product_id", "qty": "units"})]
    )


@query(
    "history_plus_forecast",
    """SELECT product_id, date, qty, 'history' AS part FROM demand WHERE date >= DATE '1999-01-01'
       UNION ALL SELECT product_id, date, y_pred, 'forecast' FROM forecast WHERE year(date) = 2001""",
    ctes="demand forecast",
    doubles="qty",
)
def _(t):
    return U.history_plus_forecast(t.demand, t.forecast, "1999-01-01", 2001)


# ---- quality -------------------------------------------------------------------------------------


@query(
    "quality_snapshot",
    """SELECT '{"n_rows":' || count(*) || ',"n_products":' || count(DISTINCT product_id) || ',"n_internal":' || count(*) FILTER (kind = 'interno')
       || ',"n_external":' || count(*) FILTER (kind = 'externo') || ',"n_duplicates":0,"n_asymmetric":' ||
       (SELECT count(*) FROM (SELECT DISTINCT product_id, substitute_id FROM unified_subs a WHERE kind = 'externo' AND NOT EXISTS (SELECT 1 FROM unified_subs b WHERE b.product_id = a.substitute_id AND b.substitute_id = a.product_id)))
       || ',"n_unusual":' || count(*) FILTER (kind = 'externo' AND score < 0.7) || '}' AS snapshot FROM unified_subs""",
    ctes="unified_subs",
)
def _(t):
    return U.quality_snapshot(unified_subs(t))


@query(
    "consolidate_by_priority",
    """SELECT product_id, year, CASE WHEN p = 3 THEN 'top_venta' WHEN p = 2 THEN 'mixto' ELSE 'pico_aislado' END AS kind,
       CASE WHEN p = 3 THEN 'sin_cambio' WHEN p = 2 THEN 'alerta_pendiente' ELSE 'suavizado_a015' END AS decision
       FROM (SELECT product_id, year, max(p) AS p FROM (SELECT product_id, year, CASE WHEN kind = 'top_venta' THEN 3 ELSE 2 END AS p FROM kinds
       UNION ALL SELECT product_id, CAST(year(date) AS INTEGER), 1 FROM flagged_keys) GROUP BY product_id, year)""",
    ctes="kinds flagged_keys",
)
def _(t):
    b = flagged_keys(t).select("product_id", F.year("date").alias("year"), F.lit("pico_aislado").alias("kind"))
    return O.consolidate_by_priority(kinds(t), b, ["product_id", "year"])
