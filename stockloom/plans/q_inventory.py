"""Queries over stock, replenishment and published views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.functions import pricing as P
from stockloom.operators import aggregates as A
from stockloom.operators import inventory as I
from stockloom.operators import joins as J
from stockloom.operators import receipts as R
from stockloom.operators import views as V
from stockloom.operators import windows as W
from stockloom.plans.bindings import CTES
from stockloom.plans.q_relational import PREF_PRIORITY, ledger_run, open_stores, top_flags, unified_subs
from stockloom.plans.registry import query
from stockloom.session import shared_folder, written

STAMP = "20250101_000000"


def stock_now(t):
    return t.inventory


CTES["stock_now"] = ("inventory", "SELECT * FROM inventory")
CTES["after_orders"] = (
    "stock_now sales",
    "SELECT i.*, stock - coalesce(CAST(s AS BIGINT), 0) AS raw FROM stock_now i LEFT JOIN (SELECT product_id, sum(qty) AS s FROM sales GROUP BY product_id) USING (product_id)",
)


@query(
    "apply_customer_orders",
    """SELECT product_id, stock, greatest(raw, 0) AS stock_new, greatest(raw, 0) - stock AS delta FROM after_orders
       UNION ALL SELECT product_id, NULL, NULL, CAST(sum(qty) AS BIGINT) FROM sales WHERE product_id NOT IN (SELECT product_id FROM stock_now) GROUP BY product_id""",
    ctes="after_orders sales",
)
def _(t):
    a = I.apply_customer_orders(stock_now(t), t.order_lines).select("product_id", "stock", "stock_new", "delta")
    lost = I.unmatched_orders(stock_now(t), t.order_lines)
    null = F.lit(None).cast("long")
    return a.unionByName(lost.select("product_id", null.alias("stock"), null.alias("stock_new"), F.col("qty").alias("delta")))


@query(
    "order_alerts",
    f"""SELECT '{STAMP}' AS timestamp, 'WARN' AS severity, 'Pedido recibido para item desconocido ' || product_id AS message, product_id, NULL::VARCHAR AS supplier_id FROM order_lines WHERE product_id NOT IN (SELECT product_id FROM stock_now)
        UNION ALL SELECT '{STAMP}', 'CRIT', 'Rotura detectada tras pedido (item ' || product_id || ')', product_id, supplier FROM ledger_run JOIN (SELECT product_id, supplier FROM inventory) USING (product_id) WHERE stock_after <= 0
        UNION ALL SELECT '{STAMP}', 'CRIT', 'Sin sustitutos disponibles para item ' || product_id, product_id, NULL FROM after_orders WHERE raw <= 0 AND product_id NOT IN (SELECT product_id FROM good_subs)""",
    ctes="order_lines ledger_run after_orders good_subs inventory",
)
def _(t):
    subs = t.substitutes_external.where("score >= 0.7")
    return I.order_alerts(t.order_lines, stock_now(t), ledger_run(t), subs, STAMP)


CTES["suggested"] = (
    "after_orders offers",
    f"""SELECT product_id, stock, rop, supplier_id, price, moq, multiple, qty, qty * price AS amount, CASE WHEN stock <= 0 THEN 'rotura' ELSE 'bajo_stock' END AS reason FROM (
        SELECT *, CAST(CASE WHEN w <= 0 THEN 0 WHEN multiple <= 1 THEN w ELSE ceil(w / multiple) * multiple END AS BIGINT) AS qty FROM (
          SELECT *, greatest(-stock, 0, moq) AS w FROM (SELECT product_id, raw AS stock, CAST(250 AS BIGINT) AS rop FROM after_orders WHERE raw < 250)
          LEFT JOIN (SELECT product_id, supplier_id, price, CAST(availability AS BIGINT) % 40 AS moq, CAST(supplier_id % 7 AS BIGINT) AS multiple FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {PREF_PRIORITY}) AS rn FROM offers) WHERE rn = 1) USING (product_id)))""",
)


def suggested(t):
    stock = I.apply_customer_orders(stock_now(t), t.order_lines, clip_zero=False)
    stock = stock.select("product_id", F.col("stock_new").alias("stock"), F.lit(250).cast("long").alias("rop"))
    offers = t.offers.withColumn("moq", F.col("availability").cast("long") % 40).withColumn("multiple", F.col("supplier_id") % 7)
    return I.purchase_suggestions(stock, offers)


@query("purchase_suggestions", "SELECT * FROM suggested", ctes="suggested", doubles="price amount")
def _(t):
    return suggested(t)


CTES["po_lines"] = ("suggested", f"SELECT 'PO_' || supplier_id || '_{STAMP}' AS order_id, product_id, reason, qty, price, amount, supplier_id AS supplier FROM suggested")


@query(
    "purchase_orders",
    "SELECT order_id, supplier, count(*) AS n_lines, sum(amount) AS amount FROM po_lines GROUP BY order_id, supplier",
    ctes="po_lines",
    doubles="amount",
    digits=2,
)
def _(t):
    return I.purchase_orders(suggested(t), STAMP)[1]


@query("purchase_order_lines", "SELECT * FROM po_lines", ctes="po_lines", doubles="price amount")
def _(t):
    return I.purchase_orders(suggested(t), STAMP)[0]


@query(
    "receive_order",
    f"""SELECT coalesce(i.product_id, g.product_id) AS product_id, coalesce(stock, 0) + coalesce(q, 0) AS stock FROM stock_now i
        FULL JOIN (SELECT product_id, CAST(sum(qty) AS BIGINT) AS q FROM po_lines WHERE order_id = 'PO_3_{STAMP}' GROUP BY product_id) g ON i.product_id = g.product_id""",
    ctes="stock_now po_lines",
)
def _(t):
    lines = I.purchase_order_lines(suggested(t), STAMP)
    return I.receive_order(stock_now(t), lines, f"PO_3_{STAMP}", "2001-12-01")[0].select("product_id", "stock")


ARRIVALS = [("2001-12-01", [3]), ("2001-12-02", [3, 5]), ("2001-12-03", [5])]  # orders by supplier; repeats book nothing


def received(t):
    """Stock folder after three arrivals, of which two repeat orders that were booked before."""
    path = f"{shared_folder(t.spark).rstrip('/')}/stock/{uuid.uuid4().hex}"
    lines = written(I.purchase_order_lines(suggested(t), STAMP))
    R.open_stock(stock_now(t), path)
    for day, suppliers in ARRIVALS:
        orders = lines.where(F.col("supplier").isin(suppliers)).select("order_id").distinct()
        R.receive_lines(lines, path, day, orders)
    return path, lines


CTES["booked"] = (
    "po_lines",
    f"""SELECT CASE supplier WHEN 3 THEN DATE '{ARRIVALS[0][0]}' ELSE DATE '{ARRIVALS[1][0]}' END AS date, order_id, product_id, qty
        FROM po_lines WHERE supplier IN (3, 5) AND qty > 0""",
)


@query(
    "received_stock",
    """SELECT coalesce(i.product_id, g.product_id) AS product_id, CAST(coalesce(stock, 0) + coalesce(q, 0) AS BIGINT) AS stock FROM stock_now i
       FULL JOIN (SELECT product_id, sum(qty) AS q FROM booked GROUP BY product_id) g ON i.product_id = g.product_id""",
    ctes="stock_now booked",
)
def _(t):
    """The newest stock version after all arrivals."""
    return R.stock_at(t.spark, received(t)[0]).select("product_id", "stock")


@query("receipt_ledger", f"SELECT date, order_id, product_id, '{R.MOVEMENT}' AS movement, CAST(qty AS BIGINT) AS qty FROM booked", ctes="booked")
def _(t):
    """Ledger rows of the lines that the arrivals booked, each once."""
    return R.receipt_ledger(R.receipts_at(t.spark, received(t)[0]))


@query(
    "order_status",
    f"""SELECT order_id, count(*) FILTER (qty > 0 AND supplier NOT IN (3, 5)) AS n_open,
        CASE WHEN count(*) FILTER (qty > 0) > 0 AND count(*) FILTER (qty > 0 AND supplier NOT IN (3, 5)) = 0 THEN '{R.RECEIVED}' ELSE 'Pendiente' END AS status
        FROM po_lines GROUP BY order_id""",
    ctes="po_lines",
)
def _(t):
    """Status of every purchase order after the arrivals."""
    path, lines = received(t)
    headers = lines.select("order_id").distinct().withColumn("status", F.lit("Pendiente"))
    return R.order_status(headers, lines, R.receipts_at(t.spark, path)).select("order_id", "n_open", "status")


@query(
    "canonical_ledger",
    """SELECT date, CAST(s.product_id AS VARCHAR) AS product_id, name, supplier, CASE WHEN flag = 'A' THEN 'Devolución' WHEN flag = 'N' THEN 'Venta' ELSE 'Entrada' END AS movement,
       CAST(qty AS BIGINT) AS qty FROM sales s LEFT JOIN catalog c ON c.product_id = s.product_id""",
    ctes="sales catalog",
)
def _(t):
    q, f = F.col("qty"), F.col("flag")
    raw = t.sales.select(
        F.col("date").cast("timestamp").alias("date"), F.concat(F.col("product_id").cast("string"), F.lit(".0")).alias("product_id"),
        F.when(f == "A", "Devolución").when(f == "N", " ").alias("movement"),
        F.when(f == "A", q.cast("string")).otherwise("n/a").alias("qty"),
        F.when(f == "N", -q).when(f == "R", q).alias("delta"),
    )
    return I.canonical_ledger(raw, t.catalog)


_DOW = ", ".join(f"avg(qty) FILTER (isodow(date) = {d + 1}) / avg(qty) AS f{d}" for d in range(7))
CTES["dow_stats"] = ("demand", f"SELECT product_id, avg(qty) AS mu, stddev_samp(qty) AS sigma, {_DOW} FROM demand GROUP BY product_id")


@query("demand_stats_by_dow", "SELECT * FROM dow_stats", ctes="dow_stats", doubles="mu sigma f0 f1 f2 f3 f4 f5 f6")
def _(t):
    return I.demand_stats_by_dow(t.demand)


CTES["lead_items"] = (
    "stock_now offers",
    "SELECT product_id, stock, lead_time FROM (SELECT product_id, stock FROM stock_now) LEFT JOIN (SELECT product_id, min(lead_time) AS lead_time FROM offers GROUP BY product_id) USING (product_id)",
)
CTES["safety"] = (
    "lead_items dow_stats",
    """SELECT product_id, stock, lead_time, mu AS mu_day, mu * sf AS mu_lead, CASE WHEN mu > 0 AND lead_time > 0 THEN greatest(raw_ss, 3) ELSE raw_ss END AS ss FROM (
       SELECT *, CAST(ceil(1.6449::DOUBLE * greatest(CASE WHEN sigma > 0 THEN sigma ELSE 0.45 * mu END, sqrt(mu)) * sqrt(sf2)) AS BIGINT) AS raw_ss FROM (
         SELECT product_id, stock, lead_time, mu, sigma, sum(f) AS sf, sum(f * f) AS sf2 FROM (
           SELECT i.*, s.mu, s.sigma, coalesce(CASE (i.k + 0) % 7 WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 WHEN 4 THEN f4 WHEN 5 THEN f5 ELSE f6 END, 1.0) AS f
           FROM (SELECT *, unnest(generate_series(0, lead_time - 1)) AS k FROM lead_items) i JOIN (SELECT * REPLACE (ceil(mu) AS mu) FROM dow_stats) s USING (product_id)) GROUP BY ALL))""",
)


def lead_items(t):
    return stock_now(t).select("product_id", "stock").join(A.min_lead_time(t.offers, "product_id", "lead_time"), "product_id", "left")


def safety(t):
    return I.safety_stock_dynamic(lead_items(t), I.demand_stats_by_dow(t.demand), "2001-12-03", min_ss=3)


@query("safety_stock_dynamic", "SELECT * FROM safety", ctes="safety", doubles="mu_day mu_lead")
def _(t):
    return safety(t)


@query(
    "reorder_point",
    """SELECT *, stock < 0 AS broken, stock >= 0 AND stock < rop AS below_rop FROM (SELECT product_id, stock, lead_time, mu_day, mu_lead, ss,
       CAST(round_even(floor(mu_lead * 1e6 + 0.5) / 1e6, 0) + ss AS BIGINT) AS rop, CAST(floor(stock / mu_day) AS BIGINT) AS cover_days FROM safety)""",
    ctes="safety",
    doubles="mu_day mu_lead",
)
def _(t):
    return I.reorder_point(safety(t))


@query(
    "rop_lead_time_forecast",
    """SELECT product_id, lead_time, f AS forecast_lead, 0.2 * f AS ss, f + 0.2 * f AS rop FROM (SELECT i.product_id, i.lead_time, coalesce(sum(y_pred), 0.0) AS f FROM lead_items i
       LEFT JOIN forecast f ON f.product_id = i.product_id AND f.date >= DATE '2001-03-01' AND f.date < DATE '2001-03-01' + i.lead_time GROUP BY i.product_id, i.lead_time)""",
    ctes="lead_items forecast",
    doubles="forecast_lead ss rop",
)
def _(t):
    return I.rop_lead_time_forecast(t.forecast, lead_items(t), "2001-03-01")


CTES["lead_lookup"] = (
    "inventory pref_stock",
    """SELECT i.product_id, i.supplier, i.stock, CAST(coalesce(p.lt, s.lt, 7) AS INTEGER) AS lead_time FROM inventory i LEFT JOIN (SELECT product_id, lead_time AS lt FROM pref_stock) p USING (product_id)
       LEFT JOIN (SELECT 'S' || supplier_id AS supplier, min(lead_time) AS lt FROM pref_stock GROUP BY 1) s ON s.supplier = i.supplier""",
)


def lead_lookup(t):
    pref = W.preferred_supplier_stock_first(t.offers)
    name = F.concat(F.lit("S"), F.col("supplier_id").cast("string")).alias("supplier")
    items = t.inventory.select("product_id", "supplier", "stock")
    return I.lead_time_lookup(items, pref, pref.select(name, "lead_time"))


@query("lead_time_lookup", "SELECT * FROM lead_lookup", ctes="lead_lookup")
def _(t):
    return lead_lookup(t)


CTES["recommended"] = (
    "lead_lookup forecast otw top_flags subs_summary",
    """SELECT w.*, stock < 0 AS broken, stock < rop AS below_rop, stock < ss AS below_ss, CAST(round_even(greatest(rop + forecast_lead - stock, 0), 0) AS BIGINT) AS recommended,
       coalesce(o.qty, 0) AS on_the_way, o.eta_min, coalesce(f.top_sales, false) AS top_sales, coalesce(s.subs_count, 0) AS subs_count, coalesce(s.subs_ids, '') AS subs_ids FROM (
         SELECT product_id, supplier, stock, lead_time, m AS sales_mean, greatest(m * lead_time, 0) AS forecast_lead, m * 0.5 * lead_time AS ss, m * lead_time + m * 0.5 * lead_time AS rop FROM (
           SELECT l.product_id, l.supplier, l.stock - 300 AS stock, l.lead_time, coalesce(x.m, 0.0) AS m FROM lead_lookup l LEFT JOIN (SELECT product_id, avg(y_pred) AS m FROM forecast GROUP BY product_id) x USING (product_id))) w
       LEFT JOIN otw o USING (product_id) LEFT JOIN top_flags f USING (product_id) LEFT JOIN subs_summary s USING (product_id)""",
)


def recommended(t):
    subs = A.substitutes_summary(t.substitutes_external.where("score >= 0.7"), "product_id", "substitute_id")
    items = lead_lookup(t).withColumn("stock", F.col("stock") - 300)
    return I.replenishment_recommendation(items, t.forecast, A.on_the_way_by_product(open_stores(t)), top_flags(t), subs)


@query("replenishment_recommendation", "SELECT * FROM recommended", ctes="recommended", doubles="sales_mean forecast_lead ss rop")
def _(t):
    return recommended(t)


@query(
    "alert_chips",
    """SELECT product_id, concat_ws(' · ', CASE WHEN broken THEN '🔴 Rotura' END, CASE WHEN broken AND subs_count > 0 THEN '♻️ Sustitutos: ' || subs_count || CASE WHEN subs_ids <> '' THEN ' [' || subs_ids || ']' ELSE '' END END,
       CASE WHEN below_rop THEN '🟠 ROP bajo' END, CASE WHEN below_ss THEN '🟡 SS bajo' END, CASE WHEN on_the_way > 0 THEN '🚚 En camino: ' || on_the_way || coalesce(' (ETA~' || eta_min || 'd)', '') END,
       CASE WHEN top_sales THEN '🏆 Top ventas' END) AS alerts FROM recommended""",
    ctes="recommended",
)
def _(t):
    df = recommended(t)
    return df.select("product_id", I.alert_chips(df).alias("alerts"))


@query(
    "supplier_qc_report",
    """SELECT 'WARN' AS kind, product_id, 'Producto sin proveedor en supplier_catalog' AS detail FROM catalog WHERE product_id NOT IN (SELECT product_id FROM offers)
       UNION ALL SELECT 'INFO', product_id, count(DISTINCT supplier_id) || ' proveedores (se genera ranking interno)' FROM offers GROUP BY product_id HAVING count(DISTINCT supplier_id) > 1
       UNION ALL SELECT 'WARN', product_id, 'Multiproveedor sin substitutes_internal (revisar datos)' FROM offers GROUP BY product_id HAVING count(DISTINCT supplier_id) > 1 AND product_id NOT IN (SELECT product_id FROM offers WHERE priority > 1)
       UNION ALL SELECT 'WARN', product_id, 'Sin proveedor preferente asignado' FROM catalog WHERE product_id NOT IN (SELECT product_id FROM pref_stock)""",
    ctes="catalog offers pref_stock",
)
def _(t):
    o = t.offers
    return I.supplier_qc_report(t.catalog, o, W.preferred_supplier_stock_first(o), o.where("priority > 1"))  # later offers are the internal substitutes


@query(
    "multi_supplier_rules",
    """SELECT *, v1_broken = 0 AS v1_ok, v2_broken = 0 AS v2_ok, v3_broken = 0 AS v3_ok, v4_broken = 0 AS v4_ok FROM (
       SELECT count(*) AS rows, count(*) FILTER (o.supplier_id = p.supplier_id) AS v1_broken, count(*) FILTER (NOT abs(o.price - p.price) > 0.005 * abs(p.price)) AS v2_broken,
         count(*) FILTER (o.availability = p.availability) AS v3_broken, count(*) FILTER (o.supplier_id % 5 = 0 AND o.lead_time <= 7) AS v4_broken FROM offers o JOIN pref_priority p USING (product_id) WHERE o.priority > 1)""",
    ctes="offers pref_priority",
)
def _(t):
    bucket = F.when(F.col("supplier_id") % 5 == 0, "10-15").otherwise(P.lead_time_bucket("lead_time"))
    return I.multi_supplier_rules(t.offers.withColumn("lead_time_bucket", bucket), W.preferred_supplier_priority_first(t.offers))


@query(
    "base_from_preferred",
    """SELECT CAST(product_id AS VARCHAR) AS product_id, CAST(supplier_id AS VARCHAR) AS supplier_id, price, availability, lead_time, CASE WHEN supplier_id = ps THEN 1 ELSE priority END AS priority,
       CASE WHEN lead_time <= 4 THEN '2-4' WHEN lead_time <= 7 THEN '5-7' ELSE '10-15' END AS lead_time_bucket FROM (SELECT o.*, p.supplier_id AS ps FROM offers o JOIN pref_stock p USING (product_id))""",
    ctes="offers pref_stock",
    doubles="price availability",
)
def _(t):
    return I.base_from_preferred(W.preferred_supplier_stock_first(t.offers), t.offers)


# ---- views ---------------------------------------------------------------------------------------

CTES["v_pref"] = (
    "pref_priority",
    """SELECT product_id, supplier_id AS preferred_supplier_id, price AS preferred_price, lead_time AS preferred_lead_time, availability AS preferred_availability, priority AS preferred_priority,
       CASE WHEN lead_time <= 4 THEN '2-4' WHEN lead_time <= 7 THEN '5-7' ELSE '10-15' END AS preferred_bucket FROM pref_priority""",
)
CTES["v_subs"] = (
    "unified_subs",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY {PREF_PRIORITY}) AS INTEGER) AS rank FROM unified_subs WHERE kind = 'interno'
        UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY score DESC, substitute_id) AS INTEGER) FROM unified_subs WHERE kind = 'externo' AND score >= 0.7""",
)
CTES["v_use"] = (
    "stock_now demand",
    """SELECT product_id, coalesce(a, 0.0) AS use_30d, coalesce(b, 0.0) AS use_90d, coalesce(b, 0.0) / 90 AS use_daily, stock / nullif(coalesce(b, 0.0) / 90, 0) AS cover_days FROM stock_now LEFT JOIN (
       SELECT product_id, coalesce(sum(qty) FILTER (date > DATE '2001-09-30' - 30), 0) AS a, sum(qty) AS b FROM demand WHERE date <= DATE '2001-09-30' AND date > DATE '2001-09-30' - 90 GROUP BY product_id) USING (product_id)""",
)
_PREF_D = "preferred_price preferred_availability"


def v_subs(t):
    return V.view_ui_substitutes(unified_subs(t))


def v_stock(t):
    return stock_now(t).select("product_id", F.col("stock").alias("on_hand"))


def v_use(t):
    return V.daily_use(t.demand, v_stock(t), "2001-09-30")


@query("view_supplier_preferred", "SELECT * FROM v_pref", ctes="v_pref", doubles=_PREF_D)
def _(t):
    return V.view_supplier_preferred(t.offers)


@query("view_ui_substitutes", "SELECT * FROM v_subs", ctes="v_subs", doubles="score price availability")
def _(t):
    return v_subs(t)


@query(
    "view_ui_products",
    """SELECT s.*, p.* EXCLUDE (product_id), c.name, c.category, c.pack_size, i.stock AS on_hand, u.* EXCLUDE (product_id) FROM (
         SELECT product_id, count(*) FILTER (kind = 'interno') AS internal_count, count(*) FILTER (kind = 'externo') AS external_count, max(substitute_id) FILTER (kind = 'externo' AND rank = 1) AS top_external_id,
         max(score) FILTER (kind = 'externo' AND rank = 1) AS top_external_score FROM v_subs GROUP BY product_id) s
       LEFT JOIN v_pref p USING (product_id) LEFT JOIN catalog c USING (product_id) LEFT JOIN stock_now i USING (product_id) LEFT JOIN v_use u USING (product_id)""",
    ctes="v_subs v_pref v_use catalog",
    doubles=_PREF_D + " top_external_score use_30d use_90d use_daily cover_days",
)
def _(t):
    cat = t.catalog.select("product_id", "name", "category", "pack_size")
    return V.view_ui_products(v_subs(t), V.view_supplier_preferred(t.offers), cat, v_stock(t), v_use(t))


@query(
    "view_substitution_rules",
    "SELECT product_id, substitute_id AS alt_product_id, supplier_id AS alt_supplier_id, score, price, lead_time, availability, priority, rank, CASE kind WHEN 'interno' THEN 'internal' ELSE 'external' END AS alt_type FROM v_subs",
    ctes="v_subs",
    doubles="score price availability",
)
def _(t):
    return V.view_substitution_rules(v_subs(t))


@query(
    "view_replenishment",
    """SELECT p.*, coalesce(n, 0) AS substitutes_n, i.stock AS on_hand, u.use_daily, u.cover_days FROM v_pref p LEFT JOIN (SELECT product_id, count(*) AS n FROM v_subs GROUP BY product_id) s USING (product_id)
       LEFT JOIN stock_now i USING (product_id) LEFT JOIN v_use u USING (product_id)""",
    ctes="v_subs v_pref v_use",
    doubles=_PREF_D + " use_daily cover_days",
)
def _(t):
    return V.view_replenishment(V.view_supplier_preferred(t.offers), v_subs(t), v_stock(t), v_use(t).select("product_id", "use_daily", "cover_days"))


@query(
    "supplier_catalog_table",
    "SELECT product_id, name, category, price, i.stock FROM catalog LEFT JOIN (SELECT product_id, stock FROM stock_now) i USING (product_id) WHERE supplier = 'S4'",
    ctes="catalog stock_now",
    doubles="price",
)
def _(t):
    return V.supplier_catalog_table(t.catalog, stock_now(t).select("product_id", "stock"), "S4")


@query(
    "product_explorer_table",
    """SELECT c.product_id, c.name, c.category, p.* EXCLUDE (product_id), coalesce(i, 0) AS internal, coalesce(e, 0) AS external, x.stock, CASE WHEN x.stock < 200 THEN 'Low' ELSE 'OK' END AS stock_flag
       FROM catalog c LEFT JOIN v_pref p USING (product_id) LEFT JOIN (SELECT product_id, count(DISTINCT supplier_id) - 1 AS i FROM offers GROUP BY product_id) a USING (product_id)
       LEFT JOIN (SELECT product_id, count(DISTINCT substitute_id) AS e FROM good_subs GROUP BY product_id) b USING (product_id) LEFT JOIN (SELECT product_id, stock FROM stock_now) x USING (product_id)""",
    ctes="catalog v_pref offers good_subs stock_now",
    doubles=_PREF_D,
)
def _(t):
    subs = t.substitutes_external.where("score >= 0.7")
    counts = A.substitute_counts(t.offers, subs, "product_id", "supplier_id", "substitute_id")
    return V.product_explorer_table(t.catalog, V.view_supplier_preferred(t.offers), counts, stock_now(t).select("product_id", "stock"), 200)


@query(
    "internal_substitute_score",
    """SELECT o.product_id, o.supplier_id, 0.5 * coalesce(least(1, o.availability / nullif(p.availability, 0)), 0) + 0.25 * coalesce(least(1, p.lead_time::DOUBLE / nullif(o.lead_time, 0)), 0)
       + 0.25 * coalesce(least(1, p.price / nullif(o.price, 0)), 0) AS score, CAST(row_number() OVER (PARTITION BY o.product_id ORDER BY o.availability DESC, o.lead_time, o.price, o.supplier_id) AS INTEGER) AS priority
       FROM offers o JOIN pref_stock p ON p.product_id = o.product_id AND p.supplier_id <> o.supplier_id""",
    ctes="offers pref_stock",
    doubles="score",
)
def _(t):
    from stockloom.operators.similarity import internal_substitute_score

    pref = W.preferred_supplier_stock_first(t.offers)
    alt = J.internal_alternatives_join(t.offers, pref, "product_id", "supplier_id")
    return internal_substitute_score(alt).select("product_id", "supplier_id", "score", "priority")
