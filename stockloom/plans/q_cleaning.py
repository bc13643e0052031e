"""Queries over filters, cleaning and de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.operators import cleaning as C
from stockloom.operators import topk as K
from stockloom.operators import windows as W
from stockloom.plans.bindings import CTES
from stockloom.plans.registry import query
from stockloom.session import shared_folder
from stockloom.sources import io

# Raw demand with gaps and errors that the given tables do not have, made by fixed rules.
CTES["dirty"] = (
    "sales catalog",
    """SELECT CASE WHEN qty = 41 THEN NULL ELSE s.product_id END AS product_id,
       CASE WHEN qty = 44 THEN NULL ELSE date END AS date,
       CASE WHEN qty = 43 THEN NULL WHEN qty = 42 THEN -qty WHEN brand = 'Brand#5' THEN 0.0 ELSE qty END AS qty,
       status, CASE WHEN brand = 'Brand#3' THEN NULL ELSE category END AS category, order_id, line_no, supplier_id
       FROM sales s JOIN catalog c ON s.product_id = c.product_id""",
)


def dirty(t):
    q = F.col("qty")
    cat = t.catalog.select("product_id", "status", "category", "brand")
    return t.sales.join(cat, "product_id").select(
        F.when(q != 41, F.col("product_id")).alias("product_id"),
        F.when(q != 44, F.col("date")).alias("date"),
        F.when(q == 43, None).when(q == 42, -q).when(F.col("brand") == "Brand#5", 0.0).otherwise(q).alias("qty"),
        "status",
        F.when(F.col("brand") != "Brand#3", F.col("category")).alias("category"),
        "order_id",
        "line_no",
        "supplier_id",
    )


@query("read_parquet_source", "SELECT p_partkey, p_type FROM part")
def _(t):
    return io.read_parquet_source(t.spark, f"{t.folder}/part.parquet", ["p_partkey", "p_type"])


@query(
    "export_partitioned_splits",
    """SELECT c.cluster_id, s.split, coalesce(n, 0) AS rows, date_min, date_max
       FROM (SELECT DISTINCT cluster_id FROM demand_clustered) c CROSS JOIN (SELECT unnest(['train','val','test']) AS split) s
       LEFT JOIN (SELECT cluster_id, CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) = 2000 THEN 'val' ELSE 'test' END AS split,
             count(*) AS n, min(date) AS date_min, max(date) AS date_max FROM demand_clustered GROUP BY ALL) d
       ON c.cluster_id = d.cluster_id AND s.split = d.split""",
    ctes="demand_clustered",
)
def _(t):
    from stockloom.operators.forecast import temporal_split

    df = temporal_split(t.demand_clustered, "date", 1999)
    path = f"{shared_folder(t.spark).rstrip('/')}/files/{uuid.uuid4().hex}"
    io.export_partitioned_splits(df, path, "cluster_id", "split", "date")
    back = t.spark.read.schema(df.schema).parquet(path)  # what was written, folder by folder
    return io.split_catalogue(back, "cluster_id", "split", "date")


@query(
    "filter_active_products",
    "SELECT product_id, name, category, price, status FROM catalog WHERE lower(trim(status)) = 'activo'",
    ctes="catalog",
    doubles="price",
)
def _(t):
    return C.filter_active_products(t.catalog, "status", ["product_id", "name", "category", "price", "status"])


@query(
    "active_summary",
    """SELECT count(*) AS rows_before, count(*) FILTER (ok) AS rows_after, count(DISTINCT product_id) AS products_before,
       count(DISTINCT product_id) FILTER (ok) AS products_after FROM (SELECT s.product_id, lower(trim(status)) = 'activo' AS ok
       FROM sales s JOIN catalog USING (product_id))""",
    ctes="sales catalog",
)
def _(t):
    return C.active_summary(t.sales.join(t.catalog.select("product_id", "status"), "product_id"), "status", "product_id")


@query("drop_null_category", "SELECT * FROM dirty WHERE category IS NOT NULL", ctes="dirty", doubles="qty")
def _(t):
    return C.drop_null_category(dirty(t), "category")


@query(
    "filter_year_clip_negative",
    "SELECT * REPLACE (greatest(qty, 0) AS qty) FROM dirty WHERE year(date) = 1998 AND product_id IS NOT NULL AND qty IS NOT NULL",
    ctes="dirty",
    doubles="qty",
)
def _(t):
    return C.filter_year_clip_negative(dirty(t), "product_id", "date", "qty", 1998)


@query(
    "remove_negatives",
    """SELECT 'clip0' AS how, order_id, line_no, CASE WHEN qty < 0 THEN 0.0 ELSE qty END AS qty FROM dirty
       UNION ALL SELECT 'drop', order_id, line_no, qty FROM dirty WHERE qty IS NULL OR qty >= 0""",
    ctes="dirty",
    doubles="qty",
)
def _(t):
    cols = [F.col("order_id"), F.col("line_no"), F.col("qty")]
    a = C.remove_negatives(dirty(t), "qty", "clip0").select(F.lit("clip0").alias("how"), *cols)
    return a.unionByName(C.remove_negatives(dirty(t), "qty", "drop").select(F.lit("drop").alias("how"), *cols))


@query(
    "invalid_rows_with_reason",
    """SELECT * FROM (SELECT *, CASE WHEN date IS NULL THEN 'Date NaN; ' ELSE '' END || CASE WHEN qty IS NULL THEN 'Demand_Day NaN; ' ELSE '' END
       || CASE WHEN product_id IS NULL THEN 'Product_ID NaN; ' ELSE '' END || CASE WHEN qty < 0 THEN 'Demand_Day < 0; ' ELSE '' END
       || CASE WHEN date < DATE '1996-01-01' OR date > DATE '2000-12-31' THEN 'Date fuera de rango; ' ELSE '' END AS reason FROM dirty)
       WHERE reason <> ''""",
    ctes="dirty",
    doubles="qty",
)
def _(t):
    return C.invalid_rows_with_reason(dirty(t), "product_id", "date", "qty", "1996-01-01", "2000-12-31")


CTES["cascade"] = (
    "dirty",
    """SELECT *, lower(trim(status)) <> 'activo' AS r1,
       (date IS NULL OR qty IS NULL OR product_id IS NULL OR qty < 0 OR date < DATE '1995-01-01' OR date > DATE '2001-12-31') AS r2,
       category IS NULL AS r3 FROM dirty""",
)
CTES["cascade_first"] = (
    "cascade",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, date ORDER BY order_id, line_no, supplier_id, qty) AS nth,
       count(*) OVER (PARTITION BY product_id, date) AS n FROM cascade WHERE NOT r1 AND NOT r2 AND NOT r3)""",
)
CTES["cascade_stats"] = (
    "cascade_first",
    """SELECT product_id, sum(total) AS total, CAST(sum(seen) AS DOUBLE) / sum(expected) AS coverage FROM (
       SELECT product_id, year(date) AS y, sum(qty) AS total, count(DISTINCT date) AS seen, dayofyear(make_date(y, 12, 31)) AS expected
       FROM cascade_first WHERE nth = 1 GROUP BY product_id, year(date)) GROUP BY product_id""",
)
CTES["cascade_iqr"] = (
    "cascade_first cascade_stats",
    """SELECT f.*, total, coverage, q1, q3, q3 > q1 AND (qty < q1 - 1.5*(q3-q1) OR qty > q3 + 1.5*(q3-q1)) AS is_out
       FROM cascade_first f JOIN cascade_stats USING (product_id)
       JOIN (SELECT product_id, quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM cascade_first WHERE nth = 1 GROUP BY product_id)
       USING (product_id) WHERE nth = 1""",
)

_CASCADE = dict(
    product="product_id", date="date", qty="qty", status="status", category="category",
    first="1995-01-01", last="2001-12-31", min_coverage=0.009, scope="overall", iqr=True,
)


def cascade_args():
    return {**_CASCADE, "tie": [F.col(c) for c in ("order_id", "line_no", "supplier_id", "qty")]}


@query(
    "problem_case_filter",
    """SELECT product_id, date, qty, status, category, order_id, line_no, supplier_id FROM cascade_iqr
       WHERE total <> 0 AND coverage >= 0.009 AND NOT is_out""",
    ctes="cascade_iqr",
    doubles="qty",
)
def _(t):
    return C.problem_case_filter(dirty(t), **cascade_args())


@query(
    "rules_applied_per_product",
    """SELECT product_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
         SELECT product_id, 'estado_no_activo' AS rule FROM cascade WHERE r1
         UNION SELECT product_id, 'valores_invalidos' FROM cascade WHERE NOT r1 AND r2
         UNION SELECT product_id, 'categoria_nula' FROM cascade WHERE NOT r1 AND NOT r2 AND r3
         UNION SELECT product_id, 'duplicados_product_date' FROM cascade_first WHERE n > 1
         UNION SELECT product_id, 'demanda_total_cero' FROM cascade_stats WHERE total = 0
         UNION SELECT product_id, 'cobertura_baja_overall' FROM cascade_stats WHERE total <> 0 AND coverage < 0.009
         UNION SELECT product_id, 'outliers_iqr' FROM cascade_iqr WHERE total <> 0 AND coverage >= 0.009 AND is_out)
       WHERE product_id IS NOT NULL GROUP BY product_id""",
    ctes="cascade cascade_first cascade_stats cascade_iqr",
)
def _(t):
    return C.rules_applied_per_product(dirty(t), **cascade_args())


_ROW = "product_id, date, qty, status, category, order_id, line_no, supplier_id"


@query(
    "removed_rows_by_rule",
    f"""SELECT {_ROW}, 'estado_no_activo' AS rule FROM cascade WHERE r1
        UNION ALL SELECT {_ROW}, 'valores_invalidos' FROM cascade WHERE NOT r1 AND r2
        UNION ALL SELECT {_ROW}, 'categoria_nula' FROM cascade WHERE NOT r1 AND NOT r2 AND r3
        UNION ALL SELECT {_ROW}, 'duplicados_product_date' FROM cascade_first WHERE nth > 1
        UNION ALL SELECT {_ROW}, CASE WHEN total = 0 THEN 'demanda_total_cero' WHEN coverage < 0.009 THEN 'cobertura_baja_overall' ELSE 'outliers_iqr' END
        FROM cascade_iqr WHERE total = 0 OR coverage < 0.009 OR is_out""",
    ctes="cascade cascade_first cascade_stats cascade_iqr",
    doubles="qty",
)
def _(t):
    """Every row that the cascade removes, with its rule."""
    return C.removed_rows_by_rule(dirty(t), **cascade_args()).select(*_ROW.split(", "), "rule")


# Days with an unusually large order line: the list of flagged (product, date) keys.
CTES["flagged_keys"] = ("sales", "SELECT DISTINCT product_id, date FROM sales WHERE qty >= 49")
CTES["flagged"] = (
    "demand flagged_keys",
    """SELECT d.product_id, d.date, d.qty, CAST(k.product_id IS NOT NULL AS INTEGER) AS is_outlier
       FROM demand d LEFT JOIN flagged_keys k ON d.product_id = k.product_id AND d.date = k.date""",
)


def flagged_keys(t):
    return t.sales.where("qty >= 49").select("product_id", "date").distinct()


def flagged(t):
    return C.flag_rows_in_set(t.demand, flagged_keys(t), ["product_id", "date"])


@query("flag_rows_in_set", "SELECT * FROM flagged", ctes="flagged", doubles="qty")
def _(t):
    return flagged(t)


@query("extract_outlier_rows", "SELECT * FROM flagged WHERE is_outlier = 1", ctes="flagged", doubles="qty")
def _(t):
    return C.extract_outlier_rows(flagged(t))


@query(
    "outlier_row_stats",
    """SELECT count(*) AS rows, count(*) FILTER (is_outlier = 1) AS flagged, count(DISTINCT product_id) AS products,
       count(DISTINCT product_id) FILTER (is_outlier = 1) AS flagged_products FROM flagged""",
    ctes="flagged",
)
def _(t):
    return C.outlier_row_stats(flagged(t), "product_id")


@query(
    "prepare_modeling_dataset",
    """SELECT product_id, date, sales_quantity, cluster_id, precio_medio FROM (
         SELECT CAST(s.product_id AS VARCHAR) AS product_id, date, qty AS sales_quantity, cluster_id, price AS precio_medio,
           row_number() OVER (PARTITION BY s.product_id, date ORDER BY order_id, line_no, supplier_id, qty) AS nth
         FROM sales s JOIN catalog USING (product_id)) WHERE nth = 1""",
    ctes="sales catalog",
    doubles="sales_quantity precio_medio",
)
def _(t):
    df = t.sales.join(t.catalog.select("product_id", "cluster_id", "price"), "product_id")
    return C.prepare_modeling_dataset(
        df,
        rename={"qty": "sales_quantity", "price": "precio_medio"},
        casts={"product_id": "string", "sales_quantity": "double"},
        keys=["product_id", "date"],
        target="sales_quantity",
        tie=[F.col(c) for c in ("order_id", "line_no", "supplier_id", "sales_quantity")],
        columns=["product_id", "date", "sales_quantity", "cluster_id", "precio_medio", "price_virtual"],
    )


@query(
    "map_with_fallback",
    """SELECT product_id, CASE WHEN category IN ('SMALL', 'LARGE', 'MEDIUM') THEN category WHEN category = 'PROMO' THEN 'SMALL'
       WHEN category = 'ECONOMY' THEN 'MEDIUM' END AS mapped FROM catalog""",
    ctes="catalog",
)
def _(t):
    seen = t.catalog.select("category").distinct()
    valid = seen.where(F.col("category").isin("SMALL", "LARGE", "MEDIUM"))
    target = F.when(F.col("category") == "PROMO", "SMALL").when(F.col("category") == "ECONOMY", "MEDIUM")
    mapping = seen.select(F.col("category").alias("source"), target.alias("target"))
    df = C.map_with_fallback(t.catalog, valid, mapping, "category", "source", "target", "mapped")
    return df.select("product_id", "mapped")


@query(
    "text_search_filter",
    """SELECT product_id, name, supplier FROM catalog WHERE (CAST(product_id AS VARCHAR) LIKE '%gear%' OR lower(name) LIKE '%gear%'
       OR lower(supplier) LIKE '%gear%') AND supplier = 'S3'""",
    ctes="catalog",
)
def _(t):
    df = C.text_search_filter(t.catalog, "GEAR", ["product_id", "name", "supplier"], ("supplier", "S3"))
    return df.select("product_id", "name", "supplier")


@query(
    "ledger_filter",
    """SELECT * FROM (SELECT product_id, date, qty, 'S' || CAST(product_id % 10 AS VARCHAR) AS supplier,
       CASE WHEN flag = 'R' THEN 'devolucion' ELSE 'venta' END AS movement FROM sales)
       WHERE CAST(product_id AS VARCHAR) LIKE '%1%' AND supplier IN ('S1', 'S2') AND movement = 'venta'
       AND date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""",
    ctes="sales",
    doubles="qty",
)
def _(t):
    df = t.sales.select(
        "product_id", "date", "qty",
        F.concat(F.lit("S"), (F.col("product_id") % 10).cast("string")).alias("supplier"),
        F.when(F.col("flag") == "R", "devolucion").otherwise("venta").alias("movement"),
    )
    return C.ledger_filter(df, "1", ["S1", "S2"], ["venta"], "1998-01-01", "1999-06-30")


@query(
    "low_stock_flag",
    "SELECT product_id, stock, CASE WHEN stock < 200 THEN 'Low' ELSE 'OK' END AS status FROM inventory",
    ctes="inventory",
)
def _(t):
    return t.inventory.select("product_id", "stock", C.low_stock_flag("stock", 200).alias("status"))


@query(
    "window_overrides",
    """SELECT id, CASE WHEN id LIKE 'Black Friday%' THEN DATE '2001-11-20' ELSE start END AS start, "end",
       CASE WHEN id LIKE 'Black Friday%' THEN -0.2 WHEN id LIKE 'Navidad%' THEN -0.05 ELSE -0.1 END::DOUBLE AS discount
       FROM (SELECT event || '_' || year AS id, start, "end" FROM event_windows)""",
    ctes="event_windows",
    doubles="discount",
)
def _(t):
    key = F.concat_ws("_", "event", F.col("year").cast("string"))
    w = t.event_windows.select(key.alias("id"), "start", "end", F.lit(-0.1).alias("discount"))
    patch = t.event_windows.where(F.col("event").isin("Black Friday", "Navidad")).select(
        key.alias("id"),
        F.when(F.col("event") == "Black Friday", F.lit("2001-11-20").cast("date")).alias("start"),
        F.when(F.col("event") == "Navidad", -0.05).otherwise(-0.2).alias("discount"),
    )
    return C.window_overrides(w, patch, ["start", "discount"])


@query(
    "resolve_duplicates",
    """SELECT product_id, date, sum(qty) AS qty_sum, avg(qty) AS qty_mean, max(qty) AS qty_max,
       arg_min(qty, k) AS qty_first, arg_min(supplier_id, k) AS supplier_id
       FROM (SELECT *, {'a': order_id, 'b': line_no, 'c': supplier_id, 'd': qty} AS k FROM sales) GROUP BY product_id, date""",
    ctes="sales",
    doubles="qty_sum qty_mean qty_max qty_first",
)
def _(t):
    order = ["order_id", "line_no", "supplier_id", "qty"]
    return C.resolve_duplicates(t.sales, ["product_id", "date"], "qty", ["sum", "mean", "max", "first"], order, ["supplier_id"])


@query("top_products_by_units", """SELECT product_id, sum(qty) AS units FROM sales GROUP BY product_id
       ORDER BY units DESC, product_id LIMIT 25""", ctes="sales", doubles="units")
def _(t):
    return K.top_products_by_units(t.sales, "product_id", "qty", 25)


@query(
    "top_k_substitutes",
    """SELECT product_id, substitute_id, score, CAST(rank AS INTEGER) AS rank FROM (
       SELECT s.*, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, substitute_id) AS rank
       FROM substitutes_external s WHERE product_id IN (SELECT product_id FROM inventory WHERE stock < 300)) WHERE rank <= 2""",
    ctes="substitutes_external inventory",
    doubles="score",
)
def _(t):
    broken = t.inventory.where("stock < 300")
    return K.top_k_substitutes(t.substitutes_external, broken, "product_id", "substitute_id", "score", 2)


@query(
    "representative_subset",
    """WITH p AS (SELECT product_id, sum(qty) AS demand, stddev_samp(qty) / avg(qty) AS cv, max(is_outlier) AS is_outlier,
         CASE WHEN product_id % 4 < 3 THEN 0 ELSE 1 END AS cluster FROM flagged GROUP BY product_id)
       SELECT product_id, demand, is_outlier, cluster FROM (
         SELECT *, row_number() OVER (PARTITION BY cluster, is_outlier ORDER BY demand DESC, floor(cv * 1e6) DESC NULLS LAST, product_id) AS pos,
           count(*) FILTER (is_outlier = 0) OVER (PARTITION BY cluster) AS n FROM p) WHERE cluster = 1 OR pos <= floor(n * 0.6) OR is_outlier = 1""",
    ctes="flagged",
    doubles="demand",
)
def _(t):
    p = flagged(t).groupBy("product_id").agg(
        F.sum("qty").alias("demand"),
        F.floor(F.stddev_samp("qty") / F.avg("qty") * 1e6).alias("cv"),
        F.max("is_outlier").alias("is_outlier"),
    )
    p = p.withColumn("cluster", F.when(F.col("product_id") % 4 < 3, 0).otherwise(1))
    out = K.representative_subset(p, "cluster", "product_id", "demand", "cv", "is_outlier", [0], 0.6)
    return out.drop("cv")


@query(
    "top_k_categories_per_cluster",
    """SELECT cluster_id, brand, n, CAST(rank AS INTEGER) AS rank FROM (SELECT cluster_id, brand, count(*) AS n,
       row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, brand) AS rank FROM catalog GROUP BY cluster_id, brand) WHERE rank <= 5""",
    ctes="catalog",
)
def _(t):
    n = t.catalog.groupBy("cluster_id", "brand").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k_per_group(n, "cluster_id", [F.desc("n"), "brand"], 5)


@query(
    "top_k_importance",
    """SELECT feature, avg(value) AS importance FROM (SELECT cluster_id, month(date) AS feature, sum(qty) AS value FROM demand_clustered GROUP BY ALL)
       GROUP BY feature ORDER BY importance DESC, feature LIMIT 5""",
    ctes="demand_clustered",
    doubles="importance",
)
def _(t):
    df = t.demand_clustered.groupBy("cluster_id", F.month("date").cast("long").alias("feature")).agg(F.sum("qty").alias("value"))
    return K.top_k_importance(df, "feature", "value", 5)


@query(
    "keep_last_by_priority",
    """SELECT product_id, date, qty, is_outlier FROM (SELECT *, row_number() OVER (PARTITION BY product_id, date
       ORDER BY is_outlier DESC, order_id, line_no, supplier_id, qty) AS rn FROM
       (SELECT *, CAST(qty >= 40 AS INTEGER) AS is_outlier FROM sales)) WHERE rn = 1""",
    ctes="sales",
    doubles="qty",
)
def _(t):
    df = t.sales.withColumn("is_outlier", (F.col("qty") >= 40).cast("int"))
    tie = [F.col(c) for c in ("order_id", "line_no", "supplier_id", "qty")]
    out = W.keep_last_by_priority(df, ["product_id", "date"], "is_outlier", tie)
    return out.select("product_id", "date", "qty", "is_outlier")


@query(
    "duplicates_keep_all",
    "SELECT product_id, date, qty, order_id, line_no FROM (SELECT *, count(*) OVER (PARTITION BY product_id, date) AS n FROM sales) WHERE n > 1",
    ctes="sales",
    doubles="qty",
)
def _(t):
    return W.duplicates_keep_all(t.sales, ["product_id", "date"]).select("product_id", "date", "qty", "order_id", "line_no")
