"""Queries over the scalar functions. Dirty text is made from the catalogue by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.functions import pricing as P
from stockloom.functions import text as T
from stockloom.operators import calendar as cal
from stockloom.plans.registry import query


@query(
    "normalize_product_id",
    """SELECT product_id, CASE WHEN pack_size = 7 THEN NULL ELSE CAST(product_id AS VARCHAR) END AS clean FROM catalog""",
    ctes="catalog",
)
def _(t):
    pid = F.col("product_id").cast("string")
    raw = (
        F.when(F.col("pack_size") == 7, "nan")
        .when(F.col("pack_size") % 3 == 0, F.concat(pid, F.lit(".0")))
        .when(F.col("pack_size") % 3 == 1, F.concat(F.lit("  "), pid, F.lit(" ")))
        .otherwise(F.concat(F.lit("00"), pid))
    )
    return t.catalog.select("product_id", T.normalize_product_id(raw).alias("clean"))


_ACC_SQL = "'  ' || replace(replace(upper(name), 'E', 'É'), 'O', 'Ö') || '   Ñandú & co. ' || brand"


def _accented():
    up = F.upper("name")
    up = F.replace(F.replace(up, F.lit("E"), F.lit("É")), F.lit("O"), F.lit("Ö"))
    return F.concat(F.lit("  "), up, F.lit("   Ñandú & co. "), F.col("brand"))


@query(
    "normalize_category_text",
    f"""SELECT product_id, plain, trim(regexp_replace(plain, '[^a-z0-9\\s\\-/&]', '', 'g')) AS strict FROM (
        SELECT product_id, trim(regexp_replace(strip_accents(lower({_ACC_SQL})), '\\s+', ' ', 'g')) AS plain FROM catalog)""",
    ctes="catalog",
)
def _(t):
    return t.catalog.select(
        "product_id",
        T.normalize_category_text(_accented()).alias("plain"),
        T.normalize_category_text(_accented(), drop_symbols=True).alias("strict"),
    )


@query(
    "slugify",
    f"""SELECT product_id, trim(regexp_replace(lower(strip_accents({_ACC_SQL})), '[^a-z0-9]+', '-', 'g'), '-') AS slug
        FROM catalog""",
    ctes="catalog",
)
def _(t):
    return t.catalog.select("product_id", T.slugify(_accented()).alias("slug"))


@query(
    "fix_mojibake",
    """SELECT product_id, 'Hidratación ' || name || ' Energía 5 Niño' AS fixed,
       'Cosmética ' || replace(name, 'o', 'ó') AS repaired FROM catalog""",
    ctes="catalog",
)
def _(t):
    broken = F.concat(F.lit("HidrataciÃ³n "), F.col("name"), F.lit(" EnergÃ\xada Â5 NiÃ±o"))
    old = F.concat(F.lit("CosmA(c)tica   "), F.replace(F.col("name"), F.lit("o"), F.lit("Ã³")))
    return t.catalog.select(
        "product_id", T.fix_mojibake(broken).alias("fixed"), T.repair_catalog_text(old).alias("repaired")
    )


@query(
    "collapse_spaces",
    "SELECT product_id, name || ' ' || brand || ' ' || category AS clean FROM catalog",
    ctes="catalog",
)
def _(t):
    raw = F.concat(F.lit(" \t"), F.replace("name", F.lit(" "), F.lit("   ")), F.lit("\n \t "), "brand", F.lit("  "), "category")
    return t.catalog.select("product_id", T.collapse_spaces(raw).alias("clean"))


def _packed():
    n = F.col("pack_size").cast("string")
    k = F.col("pack_size") % 6
    return (
        F.when(k == 0, F.concat("name", F.lit(" 2 uds x "), n, F.lit(" ml")))
        .when(k == 1, F.concat("name", F.lit(" Creatina "), n, F.lit(",5 gr")))
        .when(k == 2, F.concat("name", F.lit(" "), n, F.lit(" Cápsulas")))
        .when(k == 3, F.concat("name", F.lit(" pack "), n, F.lit(" unidades")))
        .when(k == 4, F.concat(F.lit("Gel "), "name", F.lit(" "), n, F.lit("g")))
        .otherwise(F.col("name"))
    )


_PACK_SQL = """SELECT product_id, category,
    CASE WHEN pack_size % 6 = 1 THEN pack_size + 0.5::DOUBLE WHEN pack_size % 6 = 5 THEN NULL ELSE pack_size::DOUBLE END AS pack,
    CASE pack_size % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'capsulas' WHEN 3 THEN 'uds' WHEN 4 THEN 'g' END AS unit,
    pack_size % 6 AS k FROM catalog"""


@query("extract_pack_and_unit", f"SELECT product_id, pack, unit FROM ({_PACK_SQL})", ctes="catalog", doubles="pack")
def _(t):
    return t.catalog.select("product_id", T.pack_size(_packed()).alias("pack"), T.pack_unit(_packed()).alias("unit"))


@query(
    "unit_category_guard",
    f"""SELECT product_id, CASE WHEN bad THEN NULL ELSE pack END AS pack, CASE WHEN bad THEN NULL ELSE unit END AS unit
        FROM (SELECT *, coalesce((k = 4) OR (category = 'SMALL' AND unit <> 'ml') OR (category = 'LARGE' AND unit <> 'g'), false) AS bad
              FROM ({_PACK_SQL}))""",
    ctes="catalog",
    doubles="pack",
)
def _(t):
    family = (
        F.when(F.col("category") == "SMALL", "Bebidas isotónicas")
        .when(F.col("category") == "LARGE", "Proteínas")
        .otherwise("Otros")
    )
    df = t.catalog.select("product_id", _packed().alias("text"), family.alias("family"))
    df = df.select("*", T.pack_size("text").alias("pack"), T.pack_unit("text").alias("unit"))
    bad = T.unit_conflict("text", "family", "unit")
    return df.select(
        "product_id", F.when(~bad, F.col("pack")).alias("pack"), F.when(~bad, F.col("unit")).alias("unit")
    )


@query(
    "parse_localized_number",
    """SELECT order_id, line_no, product_id, supplier_id,
       CASE WHEN flag = 'R' THEN NULL ELSE cents / 100 END AS amount FROM (
         SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
                l_returnflag AS flag, floor(l_extendedprice * 100 + 0.5) AS cents FROM lineitem)""",
    doubles="amount",
)
def _(t):
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    whole = F.format_number(F.floor(cents / 100).cast("long"), 0)
    text = F.concat(
        F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €")
    )
    raw = F.when(F.col("l_returnflag") == "R", "abc").otherwise(text)
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        T.parse_localized_number(raw).alias("amount"),
    )


@query(
    "normalize_bool",
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_returnflag IN ('A', 'N') AS flag
       FROM lineitem""",
)
def _(t):
    raw = F.when(F.col("l_returnflag") == "A", " Sí ").when(F.col("l_returnflag") == "N", "TRUE").otherwise("otro")
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        T.normalize_bool(raw).alias("flag"),
    )


@query(
    "parse_flexible_date",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (
        F.when(F.col("o_orderstatus") == "P", "31/31/2020")
        .when(F.col("o_orderstatus") == "F", F.concat(iso, F.lit("T10:11:12.5")))
        .otherwise(F.concat(iso, F.lit(" 23:59:59")))
    )
    return t.orders.select(F.col("o_orderkey").alias("order_id"), D.parse_flexible_date(raw).alias("day"))



@query(
    "relabel_year",
    """SELECT product_id, date, day2001, day2004, day(day2001) <> day(date) AS adjusted FROM (
       SELECT product_id, date, CAST(date + to_months(CAST(12 * (2001 - year(date)) AS INTEGER)) AS DATE) AS day2001,
              CAST(date + to_months(CAST(12 * (2004 - year(date)) AS INTEGER)) AS DATE) AS day2004 FROM demand)""",
    ctes="demand",
)
def _(t):
    return t.demand.select(
        "product_id",
        "date",
        D.relabel_year("date", 2001).alias("day2001"),
        D.relabel_year("date", 2004).alias("day2004"),
        D.was_relabelled("date", 2001).alias("adjusted"),
    )


@query(
    "calendar_columns",
    """SELECT product_id, date, qty, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
       CAST(weekofyear(date) AS INTEGER) AS weekofyear, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM demand""",
    ctes="demand",
)
def _(t):
    return t.demand.withColumns(D.calendar_columns("date"))


@query(
    "days_in_year",
    """SELECT product_id, date, CAST(dayofyear(make_date(year(date), 12, 31)) AS INTEGER) AS days FROM demand""",
    ctes="demand",
)
def _(t):
    return t.demand.select("product_id", "date", D.days_in_year(F.year("date")).alias("days"))


@query(
    "easter_and_moving_feasts",
    """SELECT year, easter, blue_monday, last_friday AS black_friday, CAST(last_friday + 3 AS DATE) AS cyber_monday,
       black_friday AS black_friday_fourth, prime_day FROM feasts""",
    ctes="feasts",
)
def _(t):
    return cal.moving_feasts(t.years)


_PRICE_CASE = """CASE WHEN e LIKE '%black%' OR e LIKE '%bf%' OR e LIKE '%cyber%' THEN {0}
    WHEN e LIKE '%rebaj%' OR e LIKE '%sale%' THEN {1} WHEN e LIKE '%navid%' OR e LIKE '%christ%' OR e LIKE '%xmas%' THEN {2}
    WHEN e LIKE '%verano%' OR e LIKE '%summer%' THEN {3} ELSE {4} END"""
PRICE_PREFIX_SQL = _PRICE_CASE.format("'bf'", "'rebajas'", "'navidad'", "'verano'", "'evento'")
PRICE_DISCOUNT_SQL = _PRICE_CASE.format(
    "-0.25::DOUBLE", "-0.15::DOUBLE", "-0.10::DOUBLE", "-0.10::DOUBLE", "-0.10::DOUBLE"
)
PRICE_SCOPE_SQL = _PRICE_CASE.format("'1|2'", "'0|1|2|3'", "'0'", "'0'", "'0|1|2|3'")
FACTOR_TYPE_SQL = """CASE WHEN e LIKE '%black%' OR e LIKE '%bf%' OR e LIKE '%cyber%' OR e LIKE '%rebaj%' OR e LIKE '%navid%'
    OR e LIKE '%xmas%' OR e LIKE '%christ%' THEN 'season_extra' WHEN e LIKE '%agosto%' THEN 'agosto_nonprice'
    WHEN e LIKE '%marketing%' THEN 'marketing_push' ELSE 'season_extra' END"""
FACTOR_NOTE_SQL = """CASE WHEN e LIKE '%black%' OR e LIKE '%bf%' OR e LIKE '%cyber%' THEN 'black_friday' WHEN e LIKE '%rebaj%' THEN 'rebajas'
    WHEN e LIKE '%navid%' OR e LIKE '%xmas%' OR e LIKE '%christ%' THEN 'navidad' WHEN e LIKE '%agosto%' THEN 'agosto_nonprice'
    WHEN e LIKE '%marketing%' THEN 'newsletter/display' ELSE 'evento_general' END"""


@query(
    "classify_event",
    f"""SELECT date, year, event, {PRICE_PREFIX_SQL} AS id_prefix, {PRICE_DISCOUNT_SQL} AS discount, {PRICE_SCOPE_SQL} AS scope_values,
        {FACTOR_TYPE_SQL} AS factor_type, {FACTOR_NOTE_SQL} AS notes,
        CASE WHEN e LIKE '%agosto%' THEN 0.95::DOUBLE ELSE 1.12::DOUBLE END AS lift
        FROM (SELECT *, lower(event) AS e FROM real_events)""",
    ctes="real_events",
    doubles="discount lift",
)
def _(t):
    return t.real_events.withColumns(P.price_class("event")).withColumns(P.factor_class("event"))


@query(
    "parse_scope_values",
    """SELECT product_id, unnest(CASE WHEN category = 'PROMO' THEN [] ELSE [product_id, CAST(pack_size AS BIGINT)] END) AS value
       FROM catalog""",
    ctes="catalog",
)
def _(t):
    sep = F.when(F.col("pack_size") % 2 == 0, "|").otherwise(",")
    text = F.when(F.col("category") == "PROMO", "").otherwise(
        F.concat(F.col("product_id").cast("string"), sep, F.lit(" "), F.col("pack_size").cast("string"))
    )
    return t.catalog.select("product_id", F.explode(T.parse_scope_values(text)).alias("value"))


@query(
    "ceil_to_multiple",
    """SELECT product_id, date, CAST(CASE WHEN x <= 0 THEN 0 WHEN m <= 1 THEN x ELSE ceil(x / m) * m END AS BIGINT) AS qty
       FROM (SELECT product_id, date, qty - 10 AS x, day(date) % 7 AS m FROM demand)""",
    ctes="demand",
)
def _(t):
    m = F.dayofmonth("date") % 7
    return t.demand.select("product_id", "date", P.ceil_to_multiple(F.col("qty") - 10, m).alias("qty"))


@query(
    "lead_time_bucket",
    """SELECT product_id, supplier_id, lead_time, CASE WHEN lead_time BETWEEN 2 AND 4 THEN '2-4'
       WHEN lead_time BETWEEN 5 AND 7 THEN '5-7' ELSE '10-15' END AS bucket FROM offers""",
    ctes="offers",
)
def _(t):
    return t.offers.select("product_id", "supplier_id", "lead_time", P.lead_time_bucket("lead_time").alias("bucket"))


EPS_SQL = "CASE cluster_id WHEN 0 THEN -0.6 WHEN 1 THEN -1.0 WHEN 2 THEN -1.2 WHEN 3 THEN -0.8 ELSE -1.0 END::DOUBLE"
CAP_SQL = "CASE cluster_id WHEN 0 THEN 1.8 WHEN 1 THEN 2.2 WHEN 2 THEN 2.8 WHEN 3 THEN 2.0 ELSE 2.0 END::DOUBLE"


@query(
    "elasticity_multiplier",
    f"""SELECT order_id, line_no, product_id, supplier_id,
        greatest(0.5, least(pow(1 - discount, {EPS_SQL}), {CAP_SQL} * CASE WHEN tax > 0.04 THEN 1.5 ELSE 1.0 END)) AS m
        FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
              l_discount * 9 AS discount, l_tax AS tax, CAST(l_partkey % 4 AS INTEGER) AS cluster_id FROM lineitem)""",
    doubles="m",
    digits=6,
)
def _(t):
    df = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_discount") * -9).alias("discount"),
        (F.col("l_tax") > 0.04).alias("on_event"),
        (F.col("l_partkey") % 4).alias("cluster_id"),
    )
    m = P.elasticity_multiplier("discount", "cluster_id", "on_event")
    return df.select("order_id", "line_no", "product_id", "supplier_id", m.alias("m"))


@query(
    "effective_price_factor",
    f"""SELECT product_id, date, pow(m, 1 / {EPS_SQL}) AS factor, price * pow(m, 1 / {EPS_SQL}) AS price_virtual
        FROM (SELECT *, 1 + (day(date) % 5) / 10 AS m FROM demand_clustered)""",
    ctes="demand_clustered",
    doubles="factor price_virtual",
)
def _(t):
    df = t.demand_clustered.withColumn("m", 1 + (F.dayofmonth("date") % 5) / 10)
    factor = P.effective_price_factor("m", "cluster_id")
    return df.select("product_id", "date", factor.alias("factor"), (F.col("price") * factor).alias("price_virtual"))


@query(
    "combine_factors",
    """SELECT product_id, date, qty * infl * promo * season AS final,
       CASE WHEN infl = 1 AND promo = 1 AND season = 1 THEN 'None' ELSE array_to_string(list_filter([
         CASE WHEN infl <> 1 THEN 'infl' END, CASE WHEN promo <> 1 THEN 'promo' END, CASE WHEN season <> 1 THEN 'season' END],
         lambda x: x IS NOT NULL), '|') END AS applied
       FROM (SELECT *, CASE WHEN year(date) > 1998 THEN 0.97 ELSE 1.0 END::DOUBLE AS infl,
             CASE WHEN day(date) BETWEEN 10 AND 20 THEN 1.1 ELSE 1.0 END::DOUBLE AS promo,
             CASE WHEN month(date) = 12 THEN 1.12 ELSE 1.0 END::DOUBLE AS season FROM demand)""",
    ctes="demand",
    doubles="final",
)
def _(t):
    df = t.demand.select(
        "*",
        F.when(F.year("date") > 1998, 0.97).otherwise(1.0).alias("M_infl"),
        F.when(F.dayofmonth("date").between(10, 20), 1.1).otherwise(1.0).alias("M_promo"),
        F.when(F.month("date") == 12, 1.12).otherwise(1.0).alias("M_season"),
    )
    cols = ["M_infl", "M_promo", "M_season"]
    return df.select(
        "product_id",
        "date",
        (F.col("qty") * P.factor_product(cols)).alias("final"),
        P.factors_applied(cols).alias("applied"),
    )


@query(
    "order_id_string",
    "SELECT s_suppkey AS supplier_id, 'PO_' || regexp_replace(s_name, '\\W+', '', 'g') || '_20250101_000000' AS order_id FROM supplier",
)
def _(t):
    return t.source("supplier").select(
        F.col("s_suppkey").alias("supplier_id"), T.order_id("s_name", "20250101_000000").alias("order_id")
    )


@query(
    "alert_text",
    """SELECT product_id, concat_ws(' · ', CASE WHEN pack_size < 10 THEN '🔴 Rotura' END,
       CASE WHEN pack_size < 30 THEN '🟠 ROP bajo' END, CASE WHEN pack_size % 2 = 0 THEN '🚚 En camino: ' || pack_size END) AS alerts
       FROM catalog""",
    ctes="catalog",
)
def _(t):
    s = F.col("pack_size")
    chips = [
        (s < 10, F.lit("🔴 Rotura")),
        (s < 30, F.lit("🟠 ROP bajo")),
        (s % 2 == 0, F.concat(F.lit("🚚 En camino: "), s.cast("string"))),
    ]
    return t.catalog.select("product_id", P.alert_text(chips).alias("alerts"))


@query(
    "format_units_ceil",
    """SELECT product_id, replace(format('{:,}', CAST(ceil(total) AS BIGINT)), ',', '.') AS units
       FROM (SELECT product_id, sum(qty) * 1.1 AS total FROM demand GROUP BY product_id)""",
    ctes="demand",
)
def _(t):
    total = t.demand.groupBy("product_id").agg((F.sum("qty") * 1.1).alias("total"))
    return total.select("product_id", T.format_units_ceil("total").alias("units"))
