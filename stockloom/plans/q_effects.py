"""Queries over calendars, event uplift, price and factor effects, noise and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.operators import aggregates as A
from stockloom.operators import calendar as cal
from stockloom.operators import effects as E
from stockloom.operators import history as HI
from stockloom.operators import windows as W
from stockloom.plans.bindings import CTES
from stockloom.plans.q_cleaning import flagged, flagged_keys
from stockloom.plans.q_functions import (
    CAP_SQL,
    EPS_SQL,
    FACTOR_NOTE_SQL,
    FACTOR_TYPE_SQL,
    PRICE_DISCOUNT_SQL,
    PRICE_PREFIX_SQL,
    PRICE_SCOPE_SQL,
)
from stockloom.plans.q_relational import scoped_windows
from stockloom.plans.registry import query
from stockloom.session import spread

_RULES = [
    ("Rebajas Invierno", 1.5, "make_date(year,1,1)", "make_date(year,1,15)"),
    ("Rebajas Verano", 1.5, "make_date(year,7,1)", "make_date(year,7,15)"),
    ("San Valentín", 1.8, "make_date(year,2,14)", None),
    ("Navidad", 1.8, "make_date(year,12,25)", None),
    ("Día del Padre", 1.2, "make_date(year,3,19)", None),
    ("Blue Monday", 1.2, "blue_monday", None),
    ("Black Friday", 3.0, "last_friday", None),
    ("Cyber Monday", 2.0, "last_friday + 3", None),
    ("Jueves Santo", 1.2, "easter - 3", None),
    ("Viernes Santo", 1.3, "easter - 2", None),
    ("Sábado Santo", 1.15, "easter - 1", None),
    ("Lunes de Pascua", 1.1, "easter + 1", None),
    ("Vuelta al cole", 1.05, "make_date(year,9,1)", "make_date(year,9,15)"),
    ("Amazon Prime Day", 1.2, "prime_day", "prime_day + 1"),
]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS event, {m}::DOUBLE AS m, {i} AS ord, CAST(unnest(generate_series({a}, {b or a}, INTERVAL 1 DAY)) AS DATE) AS date FROM feasts"
    for i, (n, m, a, b) in enumerate(_RULES)
)
CTES["event_rules"] = ("feasts", _RULE_SQL)
CTES["season_cal"] = (
    "event_rules years",
    """SELECT *, weight / sum(weight) OVER (PARTITION BY year) AS weight_norm FROM (
       SELECT *, CASE WHEN leap_note <> 'n/a' AND month = 2 AND day = 29 THEN 0 ELSE w_monthly * w_weekly * w_event END AS weight FROM (
         SELECT y.year, d.date, coalesce(e.event, '') AS event, CAST(month(d.date) AS INTEGER) AS month, CAST(day(d.date) AS INTEGER) AS day, dayname(d.date) AS weekday,
           CASE WHEN day(d.date) <= 10 THEN 1.2 WHEN day(d.date) <= 20 THEN 1.0 ELSE 0.8 END::DOUBLE AS w_monthly,
           CASE isodow(d.date) WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 1.1 END::DOUBLE AS w_weekly,
           coalesce(e.w, 1.0) AS w_event, CASE WHEN dayofyear(make_date(y.year, 12, 31)) = 366 THEN 'redistribute' ELSE 'n/a' END AS leap_note
         FROM years y, LATERAL (SELECT CAST(unnest(generate_series(make_date(y.year,1,1), make_date(y.year,12,31), INTERVAL 1 DAY)) AS DATE) AS date) d
         LEFT JOIN (SELECT date, string_agg(event, '; ' ORDER BY ord) AS event, product(m) AS w FROM event_rules GROUP BY date) e ON e.date = d.date))""",
)


def season_cal(t):
    rules = cal.default_event_rules(t.years, back_to_school=True, prime=True)
    return cal.seasonal_calendar(t.years, rules, leap="redistribute")


@query(
    "seasonal_calendar", "SELECT * FROM season_cal", ctes="season_cal", doubles="w_monthly w_weekly w_event weight weight_norm", digits=8
)
def _(t):
    return season_cal(t)


@query(
    "validate_seasonal_calendar",
    """SELECT year, n_rows, n_days, 0::BIGINT AS n_null, n_negative, CASE WHEN year = 1997 THEN 'negative_weight,sum_not_one' WHEN year = 1998 THEN 'row_count,missing_days,sum_not_one' ELSE '' END AS errors,
       year NOT IN (1997, 1998) AS ok FROM (SELECT year, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) FILTER (year = 1997 AND month = 5) AS n_negative FROM season_cal WHERE NOT (year = 1998 AND month = 6) GROUP BY year)""",
    ctes="season_cal",
)
def _(t):
    c = season_cal(t).where("not (year = 1998 and month = 6)")
    bad = F.when((F.col("year") == 1997) & (F.col("month") == 5), -F.col("weight_norm")).otherwise(F.col("weight_norm"))
    return cal.validate_seasonal_calendar(c.withColumn("weight_norm", bad))


CTES["annual"] = ("sales", "SELECT product_id, CAST(year(date) AS INTEGER) AS year, sum(qty) AS qty FROM sales GROUP BY product_id, year(date)")


def annual(t):
    return t.sales.groupBy("product_id", F.year("date").alias("year")).agg(F.sum("qty").alias("qty"))


@query(
    "seasonal_calendar_join",
    """SELECT a.product_id, year, month, count(*) AS days, sum(weight_norm) AS weight, any_value(qty) AS qty, sum(qty * weight_norm) AS qty_month
       FROM annual a JOIN season_cal USING (year) GROUP BY a.product_id, year, month""",
    ctes="annual season_cal",
    doubles="weight qty qty_month",
)
def _(t):
    days = cal.seasonal_calendar_join(spread(annual(t), "product_id", "year"), season_cal(t))  # every day of every year, folded to months for the comparison
    return days.groupBy("product_id", "year", F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("weight_norm").alias("weight"), F.max("qty").alias("qty"), F.sum("qty_day").alias("qty_month")
    )


@query(
    "disaggregate_annual",
    """SELECT a.product_id, a.year, isodow(date) AS weekday, count(*) AS days, sum(qty * weight_norm) AS qty_weekday, max(qty * weight_norm) AS qty_top_day
       FROM annual a JOIN season_cal USING (year) GROUP BY a.product_id, a.year, isodow(date)""",
    ctes="annual season_cal",
    doubles="qty_weekday qty_top_day",
)
def _(t):
    days = cal.disaggregate_annual(spread(annual(t), "product_id", "year"), season_cal(t), ["product_id", "year"])  # all years, folded to weekdays for the comparison
    return days.groupBy("product_id", "year", (F.weekday("date") + 1).cast("long").alias("weekday")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("qty_day").alias("qty_weekday"), F.max("qty_day").alias("qty_top_day")
    )


@query(
    "mass_conservation_check",
    "SELECT count(*) AS n_groups, 0.0::DOUBLE AS max_abs_error, 0::BIGINT AS n_broken FROM annual",
    ctes="annual",
    doubles="max_abs_error",
)
def _(t):
    daily = cal.disaggregate_annual(annual(t), season_cal(t), ["product_id", "year"])
    return cal.mass_conservation_check(daily, annual(t), ["product_id", "year"])


@query(
    "rebuild_history",
    """SELECT p.product_id, d.date, x.qty FROM (SELECT DISTINCT product_id FROM sales WHERE year(date) = 2000) p
       CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d
       LEFT JOIN (SELECT product_id, CAST(date + INTERVAL 12 MONTH AS DATE) AS date, qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, CAST(date + INTERVAL 12 MONTH AS DATE)
         ORDER BY date DESC, order_id DESC, line_no DESC, supplier_id DESC, qty DESC) AS rn FROM sales WHERE year(date) = 2000) WHERE rn = 1) x ON x.product_id = p.product_id AND x.date = d.date""",
    ctes="sales",
    doubles="qty",
)
def _(t):
    order = [F.col(c).desc() for c in ("date", "order_id", "line_no", "supplier_id", "qty")]
    return HI.rebuild_history(t.sales.where(F.year("date") == 2000), "product_id", "date", "qty", 2001, order)


CTES["moved_days"] = ("sales", "SELECT DISTINCT product_id, CAST(date + INTERVAL 12 MONTH AS DATE) AS date FROM sales")
CTES["history_gaps"] = (
    "moved_days",
    """SELECT product_id, year, expected, known, expected - known AS missing, known::DOUBLE / expected AS coverage, greatest(inner_, CAST(make_date(year, 12, 31) - last_known AS INTEGER)) AS longest_gap, first_known, last_known FROM (
         SELECT product_id, year, CAST(dayofyear(make_date(year, 12, 31)) AS BIGINT) AS expected, count(*) AS known, CAST(max(gap) AS INTEGER) AS inner_, min(date) AS first_known, max(date) AS last_known FROM (
           SELECT *, CAST(year(date) AS INTEGER) AS year, date - coalesce(lag(date) OVER (PARTITION BY product_id, year(date) ORDER BY date), make_date(year(date), 1, 1) - 1) - 1 AS gap FROM moved_days) GROUP BY product_id, year)""",
)


def moved_days(t):
    """All days of all years of sales, moved on by a year."""
    return t.sales.select("product_id", F.add_months("date", 12).alias("date"))


@query("history_gap_report", "SELECT * FROM history_gaps", ctes="history_gaps", doubles="coverage")
def _(t):
    """Days that a history rebuilt from the year before lacks, per product, for every year."""
    return HI.gap_report(moved_days(t), ["product_id"], "date")


@query(
    "history_metrics",
    """SELECT year, count(*) AS series, count(*) FILTER (missing = 0) AS complete, CAST(sum(missing) AS BIGINT) AS missing, sum(known)::DOUBLE / sum(expected) AS coverage,
       avg(coverage) AS mean_coverage, max(longest_gap) AS longest_gap FROM history_gaps GROUP BY year""",
    ctes="history_gaps",
    doubles="coverage mean_coverage",
)
def _(t):
    """How complete the rebuilt histories of each year are."""
    return HI.history_metrics(HI.gap_report(moved_days(t), ["product_id"], "date"))


@query("real_event_calendar", "SELECT * FROM real_events", ctes="real_events")
def _(t):
    return t.real_events


_EXPECT = """CASE WHEN event = 'Agosto' THEN 'valle' WHEN event IN ('Semana Santa', 'Festivo Nacional') THEN 'mixto' ELSE 'pico' END"""
_PASS = f"CASE WHEN expected = 'pico' THEN uplift >= 0.05 WHEN expected = 'valle' THEN uplift <= -0.05 END"


def _base_sql(daily: str, extra: str) -> str:
    return f"""SELECT *, {_PASS} AS passes FROM (SELECT *, {_EXPECT} AS expected, CASE WHEN base > 0 THEN (mean_event - base) / base END AS uplift FROM (
      SELECT e.year, e.event, (SELECT avg(total) FROM {daily} d JOIN real_events r ON r.date = d.date WHERE r.year = e.year AND r.event = e.event) AS mean_event,
        (SELECT avg(total) FROM {daily} d WHERE year(d.date) = e.year AND month(d.date) IN (SELECT month(date) FROM real_events r WHERE r.year = e.year AND r.event = e.event) {extra}
           AND d.date NOT IN (SELECT date FROM real_events r WHERE r.year = e.year AND r.event = e.event)) AS base
      FROM event_windows e)) WHERE mean_event IS NOT NULL"""


@query("event_uplift_monthly_base", _base_sql("daily_total", ""), ctes="daily_total event_windows", doubles="mean_event base uplift")
def _(t):
    return E.event_uplift_monthly_base(t.daily_total, t.real_events)


CTES["active_daily"] = (
    "sales",
    """SELECT date, sum(qty) AS total FROM sales s JOIN (SELECT product_id AS p, year(date) AS y FROM sales GROUP BY ALL HAVING sum(qty) >= 100) a
       ON a.p = s.product_id AND a.y = year(s.date) GROUP BY date""",
)


@query("event_uplift_active_only", _base_sql("active_daily", ""), ctes="active_daily event_windows", doubles="mean_event base uplift")
def _(t):
    return E.event_uplift_active_only(t.sales, t.real_events, 100).select("year", "event", "mean_event", "base", "expected", "uplift", "passes")


@query(
    "event_uplift_dow_base",
    _base_sql("daily_total", "AND isodow(d.date) IN (SELECT isodow(date) FROM real_events r WHERE r.year = e.year AND r.event = e.event)"),
    ctes="daily_total event_windows",
    doubles="mean_event base uplift",
)
def _(t):
    return E.event_uplift_dow_base(t.daily_total, t.real_events)


_SHIFT_SQL = f"""SELECT year, event, shift, start, "end", mean_event, base, expected, uplift, {_PASS} AS passes FROM (SELECT *, {_EXPECT} AS expected, CASE WHEN base > 0 THEN (mean_event - base) / base END AS uplift FROM (
  SELECT year, event, shift, start, "end", mean_event, CASE WHEN nl >= 3 THEN local WHEN nm >= 3 THEN monthly END AS base FROM (
    SELECT w.*, (SELECT avg(total) FROM daily_total d WHERE d.date BETWEEN w.start AND w."end" AND year(d.date) = w.year) AS mean_event,
      (SELECT avg(total) FROM daily_total d WHERE d.date BETWEEN w.start - 7 AND w."end" + 7 AND year(d.date) = w.year AND d.date NOT BETWEEN w.start AND w."end") AS local,
      (SELECT count(*) FROM daily_total d WHERE d.date BETWEEN w.start - 7 AND w."end" + 7 AND year(d.date) = w.year AND d.date NOT BETWEEN w.start AND w."end") AS nl,
      (SELECT avg(total) FROM daily_total d WHERE year(d.date) = w.year AND list_contains(w.months, month(d.date)) AND d.date NOT BETWEEN w.start AND w."end") AS monthly,
      (SELECT count(*) FROM daily_total d WHERE year(d.date) = w.year AND list_contains(w.months, month(d.date)) AND d.date NOT BETWEEN w.start AND w."end") AS nm
    FROM (SELECT year, event, shift, CAST(start + shift AS DATE) AS start, CAST("end" + shift AS DATE) AS "end",
            list_transform(generate_series(CAST(date_trunc('month', start + shift) AS TIMESTAMP), CAST(date_trunc('month', "end" + shift) AS TIMESTAMP), INTERVAL 1 MONTH), lambda x: month(x)) AS months
          FROM event_windows, (SELECT unnest({{shifts}}) AS shift)) w)))"""


@query(
    "event_uplift_local_base",
    "SELECT * EXCLUDE (shift) FROM (" + _SHIFT_SQL.format(shifts="[0]") + ")",
    ctes="daily_total event_windows",
    doubles="mean_event base uplift",
)
def _(t):
    return E.event_uplift_local_base(t.daily_total, t.event_windows)


_BEST = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, event ORDER BY CASE WHEN expected = 'pico' THEN -uplift WHEN expected = 'valle' THEN uplift ELSE -abs(uplift) END, shift) AS rn
   FROM ({_SHIFT_SQL.format(shifts="[-3,-2,-1,0,1,2,3]")}) WHERE uplift IS NOT NULL) WHERE rn = 1"""


@query("best_event_shift", _BEST, ctes="daily_total event_windows", doubles="mean_event base uplift")
def _(t):
    return E.best_event_shift(t.daily_total, t.event_windows)


@query(
    "event_pass_kpi",
    f"""SELECT year, floor(1000 * avg(CASE WHEN passes THEN 1.0 ELSE 0.0 END::DOUBLE) + 0.5) / 10 AS events_ok_pct FROM ({_base_sql("daily_total", "")}) WHERE expected IN ('pico', 'valle') GROUP BY year""",
    ctes="daily_total event_windows",
    doubles="events_ok_pct",
)
def _(t):
    return E.event_pass_kpi(E.event_uplift_monthly_base(t.daily_total, t.real_events))


@query(
    "expand_windows_daily",
    'SELECT year, event, start, "end", CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS date FROM event_windows',
    ctes="event_windows",
)
def _(t):
    return cal.expand_windows_daily(t.event_windows)


CTES["price_windows"] = (
    "event_windows",
    f"""SELECT id, CAST(start - CAST(pad // 2 AS INTEGER) AS DATE) AS start, CAST("end" + CAST(pad - pad // 2 AS INTEGER) AS DATE) AS "end", discount, 'cluster' AS scope_type, scope_values FROM (
      SELECT *, greatest(CASE prefix WHEN 'bf' THEN 7 WHEN 'rebajas' THEN 25 WHEN 'navidad' THEN 10 WHEN 'verano' THEN 7 ELSE 0 END - ("end" - start + 1), 0) AS pad FROM (
        SELECT prefix || '_' || year AS id, prefix, scope_values, min(start) AS start, max("end") AS "end", avg(discount) AS discount FROM (
          SELECT *, {PRICE_PREFIX_SQL} AS prefix, {PRICE_DISCOUNT_SQL} AS discount, {PRICE_SCOPE_SQL} AS scope_values FROM (SELECT *, lower(event) AS e FROM event_windows)
          WHERE e NOT LIKE '%festivo nacional%' AND "end" - start + 1 <= 45) GROUP BY prefix, year, scope_values))""",
)


def price_windows(t):
    return E.price_windows_from_events(t.event_windows)


@query("price_windows_from_events", "SELECT * FROM price_windows", ctes="price_windows", doubles="discount")
def _(t):
    return price_windows(t)


CTES["peak_days"] = ("real_events", "SELECT DISTINCT date FROM real_events WHERE event IN ('Black Friday', 'Cyber Monday', 'Navidad')")


def peak_days(t):
    return t.real_events.where(F.col("event").isin("Black Friday", "Cyber Monday", "Navidad")).select("date").distinct()


@query(
    "price_window_preflight",
    f"""SELECT id, cluster_id, start, "end", days, discount, m AS m_expected, m - 1 AS lift_expected, overlap_days, outliers_inside, cap AS cap_limit,
        CASE WHEN m <= cap THEN 'OK' ELSE 'REVISAR' END AS cap_ok, CASE WHEN m >= 0.5 THEN 'OK' ELSE 'REVISAR' END AS floor_ok FROM (
        SELECT *, pow(1 + discount, {EPS_SQL}) AS m, {CAP_SQL} * CASE WHEN overlap_days > 0 THEN 1.5 ELSE 1 END AS cap FROM (
          SELECT id, unnest(list_transform(string_split(scope_values, '|'), lambda x: CAST(x AS INTEGER))) AS cluster_id, start, "end", CAST("end" - start + 1 AS INTEGER) AS days, discount,
            (SELECT count(*) FROM peak_days p WHERE p.date BETWEEN w.start AND w."end") AS overlap_days,
            (SELECT count(DISTINCT date) FROM flagged_keys k WHERE k.date BETWEEN w.start AND w."end") AS outliers_inside FROM price_windows w))""",
    ctes="price_windows peak_days flagged_keys",
    doubles="discount m_expected lift_expected cap_limit",
)
def _(t):
    return E.price_window_preflight(price_windows(t), peak_days(t), flagged_keys(t), [0, 1, 2, 3])


CTES["all_price_windows"] = (
    "price_windows scoped_windows",
    """SELECT id, start, "end", discount, scope_type, scope_values FROM price_windows
       UNION ALL SELECT id, start, "end", -0.3, scope_type, scope_values FROM scoped_windows WHERE scope_type = 'product_id'""",
)
CTES["mult_cluster"] = (
    "all_price_windows peak_days",
    f"""SELECT date, cluster_id, id, m FROM (SELECT *, row_number() OVER (PARTITION BY date, cluster_id ORDER BY abs(m - 1) DESC, id) AS rn FROM (
        SELECT date, cluster_id, id, greatest(0.5, least(pow(1 + discount, {EPS_SQL}), {CAP_SQL} * CASE WHEN date IN (SELECT date FROM peak_days) THEN 1.5 ELSE 1 END)) AS m FROM (
          SELECT CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS date, cluster_id, id, discount FROM (
            SELECT *, unnest(list_transform(string_split(scope_values, '|'), lambda x: CAST(x AS INTEGER))) AS cluster_id FROM all_price_windows WHERE scope_type <> 'product_id')))) WHERE rn = 1""",
)
CTES["mult_product"] = (
    "all_price_windows peak_days catalog",
    f"""SELECT date, product_id, id, greatest(0.5, least(pow(1 + discount, {EPS_SQL}), {CAP_SQL} * CASE WHEN date IN (SELECT date FROM peak_days) THEN 1.5 ELSE 1 END)) AS m FROM (
          SELECT CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS date, product_id, cluster_id, id, discount
          FROM all_price_windows JOIN catalog ON product_id IN (1, 6, 999999999) WHERE scope_type = 'product_id')""",
)


def multipliers(t):
    prod = scoped_windows(t).where("scope_type = 'product_id'").withColumn("discount", F.lit(-0.3))
    windows = price_windows(t).unionByName(prod.select("id", "start", "end", "discount", "scope_type", "scope_values"))
    return E.price_multiplier_calendar(windows, peak_days(t), [0, 1, 2, 3], t.catalog)


@query(
    "price_multiplier_calendar",
    "SELECT date, 'cluster' AS scope, cluster_id::BIGINT AS target, id, m FROM mult_cluster UNION ALL SELECT date, 'product', product_id, id, m FROM mult_product",
    ctes="mult_cluster mult_product",
    doubles="m",
)
def _(t):
    c, p = multipliers(t)
    c = c.select("date", F.lit("cluster").alias("scope"), F.col("cluster_id").cast("long").alias("target"), "id", "m")
    return c.unionByName(p.select("date", F.lit("product").alias("scope"), F.col("product_id").alias("target"), "id", "m"))


@query(
    "apply_price_effect",
    f"""SELECT product_id, date, qty, cluster_id, is_outlier, multiplier, qty * multiplier AS qty_adj, pow(multiplier, 1 / {EPS_SQL}) AS price_factor,
        price * pow(multiplier, 1 / {EPS_SQL}) AS price_virtual FROM (
        SELECT f.*, c.cluster_id, c.price, CASE WHEN is_outlier = 1 AND coalesce(p.m, k.m, 1.0) > 1 THEN 1.0 ELSE coalesce(p.m, k.m, 1.0) END AS multiplier
        FROM flagged f JOIN catalog c USING (product_id) LEFT JOIN mult_product p ON p.product_id = f.product_id AND p.date = f.date
        LEFT JOIN mult_cluster k ON k.cluster_id = c.cluster_id AND k.date = f.date)""",
    ctes="flagged catalog mult_product mult_cluster",
    doubles="qty multiplier qty_adj price_factor price_virtual",
)
def _(t):
    c, p = multipliers(t)
    cat = t.catalog.select("product_id", "price", F.when(F.col("pack_size") <= 45, F.col("cluster_id")).alias("cluster_id"))
    out = E.apply_price_effect(flagged(t).join(cat, "product_id"), c, p, t.catalog)
    return out.select("product_id", "date", "qty", "cluster_id", "is_outlier", "multiplier", "qty_adj", "price_factor", "price_virtual")


CTES["factor_windows"] = (
    "event_windows",
    f"""SELECT factor_type, start, "end", lift, notes, min(factor_type || '_' || year || '_' || start) AS id FROM (SELECT *, {FACTOR_TYPE_SQL} AS factor_type, {FACTOR_NOTE_SQL} AS notes,
        CASE WHEN e LIKE '%agosto%' THEN 0.95 ELSE 1.12 END::DOUBLE AS lift FROM (SELECT *, lower(event) AS e FROM event_windows)) GROUP BY factor_type, start, "end", lift, notes""",
)


@query("external_factor_windows", "SELECT * FROM factor_windows", ctes="factor_windows", doubles="lift")
def _(t):
    return E.external_factor_windows(t.event_windows)


CTES["sales_span"] = ("sales", 'SELECT min(date) AS start, max(date) AS "end" FROM sales')
CTES["param_windows"] = (
    "sales_span",
    """SELECT 'inflacion_cpi_' || greatest(m, start) AS id, greatest(m, start) AS start, least(last_day(m), "end") AS "end", 'inflacion_cpi' AS factor_type, 0.97::DOUBLE AS lift, 'monthly' AS notes
       FROM (SELECT start, "end", CAST(unnest(generate_series(date_trunc('month', start)::TIMESTAMP, "end"::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m FROM sales_span)
       UNION ALL SELECT f || '_' || greatest(s, start), greatest(s, start), least(e, "end"), f, lift, notes FROM (
         SELECT start, "end", f, lift, notes, make_date(y, m, a) AS s, make_date(y, m, b) AS e FROM sales_span, LATERAL (SELECT unnest(generate_series(year(start), year("end"))) AS y),
         (VALUES ('marketing_push', 4, 10, 20, 1.1::DOUBLE, 'campaign'), ('marketing_push', 9, 10, 20, 1.1, 'campaign'), ('competition_high', 6, 1, 14, 0.9, 'competitor_pressure')) v(f, m, a, b, lift, notes))
       WHERE e >= start AND s <= "end\"""",
)


def param_windows(t):
    span = t.sales.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    a = cal.monthly_windows(span, "inflacion_cpi", 0.97)
    b = cal.yearly_fixed_windows(span, [(4, 10, 20), (9, 10, 20)], "marketing_push", 1.1, "campaign")
    c = cal.yearly_fixed_windows(span, [(6, 1, 14)], "competition_high", 0.9, "competitor_pressure")
    return a.unionByName(b).unionByName(c)


@query("monthly_and_fixed_windows", "SELECT * FROM param_windows", ctes="param_windows", doubles="lift")
def _(t):
    return param_windows(t)


CTES["full_factors"] = (
    "factor_windows param_windows",
    """SELECT factor_type, lift, min(date) AS start, max(date) AS "end", factor_type || '_' || min(date) AS id FROM (
         SELECT *, date - CAST(row_number() OVER (PARTITION BY factor_type, lift ORDER BY date) AS INTEGER) AS k FROM (
           SELECT date, factor_type, max(lift) AS lift FROM (SELECT CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS date, factor_type, lift FROM
             (SELECT start, "end", factor_type, lift FROM factor_windows UNION ALL SELECT start, "end", factor_type, lift FROM param_windows)) GROUP BY date, factor_type))
       GROUP BY factor_type, lift, k""",
)


def full_factors(t):
    return E.merge_factor_calendars([E.external_factor_windows(t.event_windows), param_windows(t)])


@query("merge_factor_calendars", "SELECT * FROM full_factors", ctes="full_factors", doubles="lift")
def _(t):
    return full_factors(t)


_FC = [("inflacion_cpi", "M_inflation"), ("marketing_push", "M_promo"), ("season_extra", "M_seasonExtra"), ("competition_high", "M_competition"), ("agosto_nonprice", "M_agosto_nonprice")]
CTES["factored"] = (
    "demand full_factors",
    "SELECT *, "
    + " * ".join(["qty", *[f'"{c}"' for _, c in _FC]])
    + " AS final, coalesce(nullif(array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN \"{c}\" <> 1 THEN '{c[2:]}' END" for c in sorted(c for _, c in _FC))
    + "], lambda x: x IS NOT NULL), '|'), ''), 'None') AS applied FROM (SELECT d.*, "
    + ", ".join(f"coalesce((SELECT max(lift) FROM full_factors f WHERE f.factor_type = '{k}' AND d.date BETWEEN f.start AND f.\"end\"), 1.0) AS \"{c}\"" for k, c in _FC)
    + " FROM demand d)",
)


def factored(t):
    return E.apply_external_factors(t.demand, full_factors(t))


@query("apply_external_factors", "SELECT * FROM factored", ctes="factored", doubles="qty final " + " ".join(f'"{c}"' for _, c in _FC))
def _(t):
    return factored(t)


_U = "(CAST(concat('0x', substr(md5(k), {0}, 8)) AS BIGINT) + 1)::DOUBLE / 4294967297.0"
CTES["noised"] = (
    "demand_clustered",
    f"""SELECT product_id, date, cluster_id, qty, ceil(greatest(0, qty * exp(-0.5 * sg * sg + sg * sqrt(-2 * ln({_U.format(1)})) * cos(2 * pi() * {_U.format(9)})))) AS noised
        FROM (SELECT *, product_id || '|' || date || '|2025' AS k, CASE cluster_id WHEN 0 THEN 0.04 WHEN 2 THEN 0.06 ELSE 0.05 END::DOUBLE AS sg FROM demand_clustered)""",
)


def noised(t):
    return E.noise_augment(t.demand_clustered.drop("price"), "qty", "cluster_id", ["product_id", "date"])


@query("noise_augment", "SELECT * FROM noised", ctes="noised", doubles="qty noised")
def _(t):
    return noised(t)


@query(
    "noise_shrink_by_cluster",
    """SELECT n.*, k, greatest(qty + k * (noised - qty), 0) AS adjusted FROM noised n JOIN (
         SELECT cluster_id, least(1.0, 0.002 / (((avg(noised) - avg(qty)) / (avg(qty) + 1e-9)) + 1e-9)) AS k FROM noised GROUP BY cluster_id) USING (cluster_id)""",
    ctes="noised",
    doubles="qty noised k adjusted",
)
def _(t):
    return E.noise_shrink_by_cluster(noised(t), "cluster_id", "qty", "noised", target=0.002)


@query(
    "window_alignment_scores",
    """SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT
         (SELECT count(*) FROM e WHERE EXISTS (SELECT 1 FROM v WHERE abs(e.date - v.date) <= 3))::DOUBLE / (SELECT count(*) FROM e) AS precision,
         (SELECT count(*) FROM v WHERE EXISTS (SELECT 1 FROM e WHERE abs(e.date - v.date) <= 3))::DOUBLE / (SELECT count(*) FROM v) AS recall)""".replace(
        "FROM e ", "FROM (SELECT DISTINCT date FROM mult_cluster) e "
    ).replace("FROM v ", "FROM peak_days v ").replace("FROM e)", "FROM (SELECT DISTINCT date FROM mult_cluster) e)").replace("FROM v)", "FROM peak_days v)"),
    ctes="mult_cluster peak_days",
    doubles="precision recall f1",
)
def _(t):
    return E.window_alignment_scores(multipliers(t)[0], peak_days(t))


CTES["reweighted"] = (
    "forecast sales",
    """SELECT f.*, y_pred * 12 * m.factor * (SELECT sum(y_pred) FROM forecast) / (SELECT sum(y_pred * 12 * factor) FROM forecast JOIN (SELECT month(date) AS month, sum(qty) / (SELECT sum(qty) FROM sales) AS factor FROM sales GROUP BY 1) x ON x.month = month(date)) AS y_seasonal
       FROM forecast f JOIN (SELECT month(date) AS month, sum(qty) / (SELECT sum(qty) FROM sales) AS factor FROM sales GROUP BY 1) m ON m.month = month(f.date)""",
)


@query("seasonal_reweight_forecast", "SELECT * FROM reweighted", ctes="reweighted", doubles="y_pred y_seasonal")
def _(t):
    return E.seasonal_reweight_forecast(t.forecast, t.sales)


@query(
    "reweight_control",
    "SELECT CASE WHEN grouping(m) = 1 THEN 'TOTAL' ELSE m END AS month, sum(y_pred) AS before, sum(y_seasonal) AS after FROM (SELECT CAST(month(date) AS VARCHAR) AS m, * FROM reweighted) GROUP BY ROLLUP (m)",
    ctes="reweighted",
    doubles="before after",
)
def _(t):
    return E.reweight_control(E.seasonal_reweight_forecast(t.forecast, t.sales))


CTES["scen"] = ("metrics", "SELECT cluster_id, greatest(1 - avg(wape) / 100, 0.8) AS factor FROM metrics GROUP BY cluster_id")


@query(
    "scenario_factors",
    "SELECT 'pesimista' AS scenario, * FROM scen UNION ALL SELECT 'optimista', cluster_id, 1 + avg(wape) / 100 FROM metrics GROUP BY cluster_id",
    ctes="scen metrics",
    doubles="factor",
)
def _(t):
    a = E.scenario_factors(t.metrics, "cluster_id", "wape", "pesimista", 0.8).withColumn("scenario", F.lit("pesimista"))
    return a.unionByName(E.scenario_factors(t.metrics, "cluster_id", "wape", "optimista").withColumn("scenario", F.lit("optimista")))


@query(
    "apply_scenario",
    """SELECT cluster_id, count(*) AS rows, sum(y_pred) AS base_total, sum(y_pred * factor) AS scenario_total, 0::BIGINT AS without_factor, 100 * (sum(y_pred * factor) / sum(y_pred) - 1) AS variation_pct
       FROM forecast JOIN scen USING (cluster_id) GROUP BY cluster_id""",
    ctes="forecast scen",
    doubles="base_total scenario_total variation_pct",
)
def _(t):
    f = E.scenario_factors(t.metrics, "cluster_id", "wape", "pesimista", 0.8)
    return E.scenario_control(E.apply_scenario(t.forecast, f, "cluster_id", "y_pred"), "cluster_id", "y_pred")


@query(
    "what_if_price_promo_event",
    """SELECT product_id, c AS "case", base, base * m AS what_if, 100 * (base * m / base - 1) AS delta_pct FROM (SELECT product_id, sum(y_pred) AS base FROM forecast GROUP BY product_id),
       (SELECT 'discount_' || cluster_id AS c, pow(0.9, -1.0 - cluster_id / 10.0::DOUBLE) * 1.1 * 1.3 AS m FROM (SELECT DISTINCT cluster_id FROM catalog))""",
    ctes="forecast catalog",
    doubles="base what_if delta_pct",
)
def _(t):
    cases = t.catalog.select("cluster_id").distinct().select(
        F.concat(F.lit("discount_"), F.col("cluster_id").cast("string")).alias("case"),
        F.lit(-0.1).alias("price_pct"), (-1.0 - F.col("cluster_id") / 10).alias("elasticity"),
        F.lit(0.1).alias("promo_pct"), F.lit(0.3).alias("event_pct"),
    )
    return E.what_if_price_promo_event(t.forecast, cases)
