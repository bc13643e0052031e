"""From customer orders to stock, alerts, reorder points and purchase orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import pricing as P
from stockloom.functions.text import normalize_product_id, order_id
from stockloom.operators.aggregates import half_up, one, purchase_order_headers
from stockloom.operators.windows import priority_first_order, keep_first


def apply_customer_orders(inventory: DataFrame, orders: DataFrame, clip_zero: bool = True) -> DataFrame:
    """Stock after the summed order quantities of each product."""
    sold = orders.groupBy("product_id").agg(F.sum("qty").alias("_sold"))
    j = inventory.join(sold, "product_id", "left")
    after = F.col("stock") - F.coalesce("_sold", F.lit(0).cast("long"))
    after = F.greatest(after, F.lit(0).cast("long")) if clip_zero else after
    return j.withColumn("stock_new", after).withColumn("delta", F.col("stock_new") - F.col("stock")).drop("_sold")


def unmatched_orders(inventory: DataFrame, orders: DataFrame) -> DataFrame:
    sold = orders.groupBy("product_id").agg(F.sum("qty").alias("qty"))
    return sold.join(inventory.select("product_id"), "product_id", "left_anti")


def order_alerts(lines: DataFrame, inventory: DataFrame, ledger: DataFrame, substitutes: DataFrame, stamp: str) -> DataFrame:
    """WARN per line of an unknown item, CRIT per line that leaves no stock, CRIT per broken item without a substitute.

    ``ledger`` holds the running stock of the lines. An item is broken when its last stock is not above 0,
    which is its starting stock minus everything sold, so no ordering is needed for it. The alert of a line
    that leaves no stock names the item's ``supplier`` as ``supplier_id``; other alerts name none.
    """
    item = F.col("product_id").cast("string")

    def alert(df: DataFrame, severity: str, before: str, after: str = "") -> DataFrame:
        message = F.concat(F.lit(before), item, F.lit(after))
        supplier = F.col("_supplier") if "_supplier" in df.columns else F.lit(None)
        return df.select(
            F.lit(stamp).alias("timestamp"), F.lit(severity).alias("severity"), message.alias("message"), "product_id", supplier.cast("string").alias("supplier_id")
        )

    unknown = lines.join(inventory.select("product_id"), "product_id", "left_anti")
    supplier = F.col("supplier") if "supplier" in inventory.columns else F.lit(None).cast("string")
    hit = ledger.where("stock_after <= 0").select("product_id").join(inventory.select("product_id", supplier.alias("_supplier")), "product_id", "left")
    broken = apply_customer_orders(inventory, lines, clip_zero=False).where("stock_new <= 0").select("product_id")
    alone = broken.join(substitutes.select("product_id").distinct(), "product_id", "left_anti")
    # Texts of the alerts.
    return (
        alert(unknown, "WARN", "Pedido recibido para item desconocido ")
        .unionByName(alert(hit, "CRIT", "Rotura detectada tras pedido (item ", ")"))
        .unionByName(alert(alone, "CRIT", "Sin sustitutos disponibles para item "))
    )


def purchase_suggestions(stock: DataFrame, offers: DataFrame) -> DataFrame:
    """Quantities to buy for broken items and items below their reorder point.

    ``stock``: product_id, stock, rop. ``offers``: supplier_id, price, moq, multiple with several rows per
    product; the preferred one is taken, so no line fans out.
    """
    best = keep_first(offers, ["product_id"], priority_first_order()).select("product_id", "supplier_id", "price", "moq", "multiple")
    broken = F.col("stock") <= 0
    need = stock.where(broken | (F.col("stock") < F.coalesce("rop", F.lit(0))))
    j = need.join(best, "product_id", "left")
    wanted = F.greatest(-F.col("stock"), F.lit(0).cast("long"), F.coalesce("moq", F.lit(0)).cast("long"))
    j = j.withColumn("qty", P.ceil_to_multiple(wanted, "multiple"))
    return j.withColumn("amount", F.col("qty") * F.col("price")).withColumn(
        "reason", F.when(broken, "rotura").otherwise("bajo_stock")
    )


def purchase_order_lines(suggestions: DataFrame, stamp: str) -> DataFrame:
    return suggestions.select(
        order_id("supplier_id", stamp).alias("order_id"), "product_id", "reason", "qty", "price", "amount", F.col("supplier_id").alias("supplier")
    )


def purchase_orders(suggestions: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Lines and headers by supplier."""
    lines = purchase_order_lines(suggestions, stamp)
    return lines, purchase_order_headers(lines)


def receive_order(inventory: DataFrame, lines: DataFrame, order: str, day: str) -> tuple[DataFrame, DataFrame]:
    """Stock after the receipt, new items included, and the ledger rows of the receipt."""
    got = lines.where(F.col("order_id") == order).groupBy("product_id").agg(F.sum("qty").alias("_got"))
    zero = F.lit(0).cast("long")
    j = inventory.join(got, "product_id", "full")
    stock = j.withColumn("stock", F.coalesce("stock", zero) + F.coalesce("_got", zero)).select(*inventory.columns)
    rows = got.where("_got > 0").select(
        F.lit(day).cast("date").alias("date"), "product_id", F.lit("Entrada compra").alias("movement"), F.col("_got").alias("qty")
    )
    return stock, rows


def set_order_status(headers: DataFrame, order: str, status: str = "Recibida") -> DataFrame:
    return headers.withColumn("status", F.when(F.col("order_id") == order, status).otherwise(F.col("status")))


def canonical_ledger(raw: DataFrame, master: DataFrame) -> DataFrame:
    """Any ledger as (date, product_id, name, supplier, movement, qty).

    ``raw`` may hold qty, delta, previous and new stock, and a movement text; what is missing falls back
    from one to the next. Rows without a date or id are left out.
    """
    have = set(raw.columns)

    def number(c: str) -> Column:
        return F.col(c).cast("string").try_cast("double") if c in have else F.lit(None).cast("double")

    delta = number("delta")
    qty = F.coalesce(number("qty"), F.abs(delta), F.abs(number("stock_prev") - number("stock_new")), F.lit(0.0))
    guessed = F.when(delta < 0, "Venta").when(delta >= 0, "Entrada").otherwise("Movimiento")
    movement = F.coalesce(F.nullif(F.trim("movement"), F.lit("")), guessed) if "movement" in have else guessed
    rows = raw.select(
        F.to_date("date").alias("date"), normalize_product_id("product_id").alias("product_id"), movement.alias("movement"),
        F.abs(qty).cast("long").alias("qty"),
    ).na.drop(subset=["date", "product_id"])
    m = master.groupBy(normalize_product_id("product_id").alias("product_id")).agg(F.min("name").alias("name"), F.min("supplier").alias("supplier"))
    return rows.join(m, "product_id", "left").select("date", "product_id", "name", "supplier", "movement", "qty")


def demand_stats_by_dow(demand: DataFrame, product: str = "product_id", date: str = "date", qty: str = "qty") -> DataFrame:
    """Mean and std per product and the weekday factors mu_dow / mu, null on weekdays without sales.

    One pass of partial sums; Spark's own moments keep their digits on large totals.
    """
    mu = F.avg(qty)
    factors = [(F.avg(F.when(F.weekday(date) == d, F.col(qty))) / F.nullif(mu, F.lit(0.0))).alias(f"f{d}") for d in range(7)]
    return demand.groupBy(product).agg(mu.alias("mu"), F.stddev_samp(qty).alias("sigma"), *factors)


def safety_stock_dynamic(
    items: DataFrame, stats: DataFrame, today: str | Column, service: str = "95", min_ss: int = 0, mode: str = "dynamic", rounding: str = "ceil"
) -> DataFrame:
    """Mean demand and safety stock over the lead time of each item.

    The daily mean is rounded up to whole units first; ``rounding`` of the stock is ``ceil`` or ``nearest``.

    The days of the lead time are folded inside each row over the seven weekday factors: no row per day.
    """
    z = P.SERVICE_Z[service]
    start = F.weekday(F.lit(today).cast("date") if isinstance(today, str) else today)
    j = items.join(stats, "product_id", "left")
    mu = F.ceil(F.greatest(F.coalesce("mu", F.lit(0.0)), F.lit(0.0))).cast("double")
    lead = F.greatest(F.coalesce(F.col("lead_time").cast("int"), F.lit(0)), F.lit(0))
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(0.45 * mu)
    sigma = F.greatest(sigma, F.sqrt(mu))
    week = F.array(*[F.coalesce(f"f{d}", F.lit(1.0)) for d in range(7)])
    # The element of the weekday that lies i days after the start.
    days = F.when(lead > 0, F.transform(F.sequence(F.lit(0), lead - 1), lambda i: F.get(week, (i + start) % 7)))
    sum_f = F.coalesce(F.aggregate(days, F.lit(0.0), lambda a, f: a + f), F.lit(0.0))
    sum_f2 = F.coalesce(F.aggregate(days, F.lit(0.0), lambda a, f: a + f * f), F.lit(0.0))
    if mode == "dynamic":
        mu_l, ss = mu * sum_f, z * sigma * F.sqrt(sum_f2)
    elif mode == "fixed":
        mu_l, ss = mu * lead, 1.5 * mu
    else:
        raise ValueError(mode)
    if rounding not in ("ceil", "nearest"):
        raise ValueError(rounding)
    whole = (F.ceil(ss) if rounding == "ceil" else F.rint(ss)).cast("long")
    floored = F.when((mu > 0) & (lead > 0), F.greatest(whole, F.lit(min_ss).cast("long"))).otherwise(whole)
    return j.withColumn("mu_day", mu).withColumn("mu_lead", mu_l).withColumn("ss", floored).drop("mu", "sigma", *[f"f{d}" for d in range(7)])


def reorder_point(df: DataFrame) -> DataFrame:
    """Reorder point, days of cover and the two flags. Columns: stock, mu_day, mu_lead, ss."""
    # Sums of weekday factors carry float noise; it is taken off before the half-even rounding.
    rop = (F.rint(half_up(F.col("mu_lead"), 6)) + F.col("ss")).cast("long")
    cover = F.coalesce(F.floor(F.col("stock") / F.nullif(F.col("mu_day"), F.lit(0.0))), F.lit(0).cast("long"))
    return df.withColumn("rop", rop).withColumn("cover_days", cover).withColumn("broken", F.col("stock") < 0).withColumn(
        "below_rop", (F.col("stock") >= 0) & (F.col("stock") < F.col("rop"))
    )


def rop_lead_time_forecast(forecast: DataFrame, items: DataFrame, start: str, share: float = 0.20) -> DataFrame:
    """Forecast over the lead time from a date, with a safety stock share on top."""
    s = F.lit(start).cast("date")
    inside = (F.col("date") >= s) & (F.col("date") < F.date_add(s, F.col("lead_time")))
    days = forecast.where(F.col("date") >= s).select("product_id", "date", "y_pred")
    j = items.select("product_id", "lead_time").join(days, "product_id", "left")
    total = j.groupBy("product_id", "lead_time").agg(F.coalesce(F.sum(F.when(inside, F.col("y_pred"))), F.lit(0.0)).alias("forecast_lead"))
    return total.withColumn("ss", share * F.col("forecast_lead")).withColumn("rop", F.col("forecast_lead") + F.col("ss"))


def lead_time_lookup(items: DataFrame, by_product: DataFrame, by_supplier: DataFrame, default: int = 7) -> DataFrame:
    """Lead time of the product, else of its supplier, else the default."""
    p = by_product.groupBy("product_id").agg(F.min("lead_time").alias("_lp"))
    s = by_supplier.groupBy("supplier").agg(F.min("lead_time").alias("_ls"))
    j = items.join(p, "product_id", "left").join(s, "supplier", "left")
    return j.withColumn("lead_time", F.coalesce("_lp", "_ls", F.lit(default)).cast("int")).drop("_lp", "_ls")


def replenishment_recommendation(
    items: DataFrame, forecast: DataFrame, on_the_way: DataFrame, top_sales: DataFrame, substitutes: DataFrame
) -> DataFrame:
    """Reorder point and recommended quantity per item, with what is on its way, top sales and substitutes.

    ``items``: product_id, supplier, stock, lead_time. Every other table is one row per product.
    """
    mean = forecast.groupBy("product_id").agg(F.avg("y_pred").alias("sales_mean"))
    j = items.join(mean, "product_id", "left").withColumn("sales_mean", F.coalesce("sales_mean", F.lit(0.0)))
    lead_demand = F.greatest(F.col("sales_mean") * F.col("lead_time"), F.lit(0.0))
    j = j.withColumn("forecast_lead", lead_demand).withColumn("ss", F.col("sales_mean") * 0.5 * F.col("lead_time"))
    j = j.withColumn("rop", F.col("sales_mean") * F.col("lead_time") + F.col("ss"))
    j = (
        j.withColumn("broken", F.col("stock") < 0)
        .withColumn("below_rop", F.col("stock") < F.col("rop"))
        .withColumn("below_ss", F.col("stock") < F.col("ss"))
        .withColumn("recommended", F.rint(F.greatest(F.col("rop") + F.col("forecast_lead") - F.col("stock"), F.lit(0.0))).cast("long"))
    )
    way = on_the_way.select("product_id", F.col("qty").alias("on_the_way"), "eta_min")
    j = j.join(way, "product_id", "left").join(top_sales, "product_id", "left").join(substitutes, "product_id", "left")
    zero = F.lit(0).cast("long")
    return (
        j.withColumn("on_the_way", F.coalesce("on_the_way", zero))
        .withColumn("top_sales", F.coalesce("top_sales", F.lit(False)))
        .withColumn("subs_count", F.coalesce("subs_count", zero))
        .withColumn("subs_ids", F.coalesce("subs_ids", F.lit("")))
    )


def alert_chips(df: DataFrame) -> Column:
    """Text of the active alerts of a recommendation row, in fixed order."""
    ids = F.when(F.col("subs_ids") != "", F.concat(F.lit(" ["), "subs_ids", F.lit("]"))).otherwise("")
    eta = F.coalesce(F.concat(F.lit(" (ETA~"), F.col("eta_min").cast("string"), F.lit("d)")), F.lit(""))
    return P.alert_text([
        (F.col("broken"), F.lit("🔴 Rotura")),
        (F.col("broken") & (F.col("subs_count") > 0), F.concat(F.lit("♻️ Sustitutos: "), F.col("subs_count").cast("string"), ids)),
        (F.col("below_rop"), F.lit("🟠 ROP bajo")),
        (F.col("below_ss"), F.lit("🟡 SS bajo")),
        (F.col("on_the_way") > 0, F.concat(F.lit("🚚 En camino: "), F.col("on_the_way").cast("string"), eta)),
        (F.col("top_sales"), F.lit("🏆 Top ventas")),
    ])


def supplier_qc_report(catalog: DataFrame, offers: DataFrame, preferred: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Products without supplier, with several, with several but no alternative, and without a preferred one."""
    items = catalog.select("product_id").where("product_id is not null").distinct()
    n = offers.groupBy("product_id").agg(F.countDistinct("supplier_id").alias("_n"))
    several = n.where("_n > 1")

    def rows(df: DataFrame, kind: str, detail: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "product_id", detail.alias("detail"))

    none = items.join(n, "product_id", "left_anti")
    lonely = several.join(alternatives.select("product_id").distinct(), "product_id", "left_anti")
    unset = items.join(preferred.select("product_id").distinct(), "product_id", "left_anti")
    # Texts of the report.
    return (
        rows(none, "WARN", F.lit("Producto sin proveedor en supplier_catalog"))
        .unionByName(rows(several, "INFO", F.concat(F.col("_n").cast("string"), F.lit(" proveedores (se genera ranking interno)"))))
        .unionByName(rows(lonely, "WARN", F.lit("Multiproveedor sin substitutes_internal (revisar datos)")))
        .unionByName(rows(unset, "WARN", F.lit("Sin proveedor preferente asignado")))
    )


def multi_supplier_rules(offers: DataFrame, preferred: DataFrame, tol: float = 0.005) -> DataFrame:
    """V1 supplier differs, V2 price differs beyond the tolerance, V3 stock differs, V4 bucket fits the lead time."""
    p = preferred.select(
        "product_id", F.col("supplier_id").alias("_ps"), F.col("price").alias("_pp"), F.col("availability").alias("_pa")
    )
    j = offers.where("priority > 1").join(p, "product_id")

    def broken(ok: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1).cast("long")), F.lit(0).cast("long"))

    rules = {
        "v1": F.col("supplier_id") != F.col("_ps"),
        "v2": F.abs(F.col("price") - F.col("_pp")) > tol * F.abs("_pp"),
        "v3": F.col("availability") != F.col("_pa"),
        "v4": F.col("lead_time_bucket") == P.lead_time_bucket("lead_time"),
    }
    row = j.agg(one().alias("rows"), *[broken(ok).alias(f"{k}_broken") for k, ok in rules.items()])
    return row.withColumns({f"{k}_ok": F.col(f"{k}_broken") == 0 for k in rules})


def base_from_preferred(preferred: DataFrame, manual: DataFrame) -> DataFrame:
    """Preferred offers as base rows, with valid manual offers of other suppliers, one row per offer."""
    base = preferred.select(
        normalize_product_id("product_id").alias("product_id"), F.trim(F.col("supplier_id").cast("string")).alias("supplier_id"),
        F.col("price").cast("double").alias("price"), F.col("availability").cast("double").alias("availability"),
        F.coalesce(F.col("lead_time").cast("int"), F.lit(7)).alias("lead_time"), F.lit(1).alias("priority"),
    )
    own = base.select("product_id", F.col("supplier_id").alias("_own"))
    extra = manual.select(
        normalize_product_id("product_id").alias("product_id"), F.trim(F.col("supplier_id").cast("string")).alias("supplier_id"),
        F.col("price").cast("double").alias("price"), F.greatest(F.col("availability").cast("double"), F.lit(0.0)).alias("availability"),
        F.greatest(F.coalesce(F.col("lead_time").cast("int"), F.lit(7)), F.lit(1)).alias("lead_time"),
        F.coalesce(F.col("priority").cast("int"), F.lit(1)).alias("priority"),
    )
    extra = extra.join(own, "product_id").where(F.col("supplier_id") != F.col("_own")).drop("_own")
    order = [F.col("priority"), F.col("price").asc_nulls_last(), F.col("lead_time"), F.col("availability").desc_nulls_last()]
    kept = keep_first(base.unionByName(extra), ["product_id", "supplier_id"], order)
    return kept.withColumn("lead_time_bucket", P.lead_time_bucket("lead_time"))
