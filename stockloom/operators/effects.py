"""Event uplift, price effects, external factors, noise, seasonality and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import pricing as P
from stockloom.operators.aggregates import count_if, half_up, mode_per_product, month_product_share, one
from stockloom.operators.calendar import expand_windows_daily, expected_direction, gaps_and_islands
from stockloom.operators.joins import price_multiplier_priority_join, scope_product_join, scope_window_join
from stockloom.operators.windows import highest_lift_window_wins

# Pass thresholds and the least number of base days.
PEAK, VALLEY, MIN_BASE_DAYS = 0.05, -0.05, 3


def _passes(uplift: Column, expected: Column) -> Column:
    return F.when(expected == "pico", uplift >= PEAK).when(expected == "valle", uplift <= VALLEY)


def _scored(df: DataFrame) -> DataFrame:
    """Uplift of ``mean_event`` over ``base`` and whether it goes the expected way."""
    uplift = F.when(F.col("base") > 0, (F.col("mean_event") - F.col("base")) / F.col("base"))
    out = df.withColumn("expected", expected_direction("event")).withColumn("uplift", uplift)
    return out.withColumn("passes", _passes(F.col("uplift"), F.col("expected")))


def _event_days(events: DataFrame) -> DataFrame:
    return events.select("year", "event", "date").distinct()


def _calendar_base(daily: DataFrame, events: DataFrame, cell_of, total: str) -> DataFrame:
    """Per (year, event): mean of its days, and mean over its calendar cells without its days.

    A cell is a month, or any of the event's months with any of its weekdays. Totals per cell minus the
    event's own days give the base, so no day is paired with every event.
    """
    d = daily.select("date", F.col(total).alias("_t"), F.year("date").alias("year")).withColumns(cell_of("date"))
    cells = [c for c in cell_of("date")]
    per_cell = d.groupBy("year", *cells).agg(F.sum("_t").alias("_s"), one().alias("_n"))
    own = _event_days(events).join(d, ["year", "date"])
    own_sum = own.groupBy("year", "event").agg(F.avg("_t").alias("mean_event"), F.sum("_t").alias("_os"), one().alias("_on"))
    marked = _event_days(events).withColumns(cell_of("date"))
    touched = marked.select("year", "event", cells[0]).distinct()
    for c in cells[1:]:
        touched = touched.join(marked.select("year", "event", c).distinct(), ["year", "event"])
    base = touched.join(per_cell, ["year", *cells]).groupBy("year", "event").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    left = F.col("_n") - F.col("_on")
    joined = base.join(own_sum, ["year", "event"])
    return joined.select(
        "year", "event", "mean_event", left.alias("n_base"), F.when(left > 0, (F.col("_s") - F.col("_os")) / left).alias("base")
    )


def _month_cell(date: str) -> dict[str, Column]:
    return {"_m": F.month(date)}


def _month_dow_cell(date: str) -> dict[str, Column]:
    return {"_m": F.month(date), "_w": F.weekday(date)}


def event_uplift_monthly_base(daily: DataFrame, events: DataFrame, total: str = "total") -> DataFrame:
    """Base: the other days of the event's months."""
    return _scored(_calendar_base(daily, events, _month_cell, total)).drop("n_base")


def event_uplift_dow_base(daily: DataFrame, events: DataFrame, total: str = "total") -> DataFrame:
    """Base: the other days of the same months and weekdays as the event."""
    return _scored(_calendar_base(daily, events, _month_dow_cell, total)).drop("n_base")


def event_uplift_active_only(sales: DataFrame, events: DataFrame, min_sales: float, product: str = "product_id", qty: str = "qty") -> DataFrame:
    """As the monthly base, on products whose sales of the year reach a minimum."""
    keyed = sales.withColumn("_y", F.year("date"))
    active = keyed.groupBy(product, "_y").agg(F.sum(qty).alias("_s")).where(F.col("_s") >= min_sales).select(product, "_y")
    daily = keyed.join(active, [product, "_y"], "left_semi").groupBy("date").agg(F.sum(qty).alias("total"))
    return event_uplift_monthly_base(daily, events)


def _window_stats(daily: DataFrame, windows: DataFrame, k: int, total: str) -> DataFrame:
    """Per (year, event, shift): means inside the window and over the k days on both sides, same year."""
    wide = windows.withColumns({"_lo": F.date_sub("start", k), "_hi": F.date_add("end", k)})
    days = expand_windows_daily(wide, "_lo", "_hi", "date").where(F.year("date") == F.col("year"))
    d = days.join(daily.select("date", F.col(total).alias("_t")), "date")
    inside = F.col("date").between(F.col("start"), F.col("end"))
    keys = ["year", "event", "shift", "start", "end"]
    seen = d.groupBy(*keys).agg(
        F.avg(F.when(inside, F.col("_t"))).alias("mean_event"),
        F.avg(F.when(~inside, F.col("_t"))).alias("_local"),
        count_if(~inside).alias("_n_local"),
        F.sum(F.when(inside, F.col("_t"))).alias("_os"),
        count_if(inside).alias("_on"),
    )
    # windows without any day keep their row
    return windows.select(*keys).join(seen, keys, "left").na.fill(0, ["_n_local", "_on"])


def _with_fallback(stats: DataFrame, daily: DataFrame, total: str) -> DataFrame:
    """Local base where it has enough days, else the months of the window without the window."""
    months = daily.groupBy(F.year("date").alias("year"), F.month("date").alias("_m")).agg(F.sum(total).alias("_s"), one().alias("_n"))
    span = F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))
    # The months of a window that leaves the year (a shift in January) count in the event's own year.
    touched = stats.select("year", "event", "shift", F.explode(F.array_distinct(F.transform(span, lambda x: F.month(x)))).alias("_m"))
    monthly = touched.join(months, ["year", "_m"]).groupBy("year", "event", "shift").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    j = stats.join(monthly, ["year", "event", "shift"], "left")
    left = F.col("_n") - F.col("_on")
    fallback = F.when(left >= MIN_BASE_DAYS, (F.col("_s") - F.coalesce("_os", F.lit(0.0))) / left)
    base = F.when(F.col("_n_local") >= MIN_BASE_DAYS, F.col("_local")).otherwise(fallback)
    return j.select("year", "event", "shift", "start", "end", "mean_event", base.alias("base"))


def event_uplift_local_base(daily: DataFrame, windows: DataFrame, k: int = 7, total: str = "total") -> DataFrame:
    w = windows.select("year", "event", "start", "end", F.lit(0).alias("shift"))
    return _scored(_with_fallback(_window_stats(daily, w, k, total), daily, total)).drop("shift")


def best_event_shift(daily: DataFrame, windows: DataFrame, k: int = 7, shift_max: int = 3, total: str = "total") -> DataFrame:
    """The shift with the most expected uplift; the earliest shift wins a tie."""
    shifts = F.explode(F.sequence(F.lit(-shift_max), F.lit(shift_max)))
    moved = windows.withColumn("shift", shifts).select(
        "year", "event", "shift", F.date_add("start", F.col("shift")).alias("start"), F.date_add("end", F.col("shift")).alias("end")
    )
    scored = _scored(_with_fallback(_window_stats(daily, moved, k, total), daily, total)).where(F.col("uplift").isNotNull())
    u, e = F.col("uplift"), F.col("expected")
    wanted = F.when(e == "pico", -u).when(e == "valle", u).otherwise(-F.abs(u))
    w = Window.partitionBy("year", "event").orderBy(wanted, "shift")
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def event_pass_kpi(scored: DataFrame) -> DataFrame:
    judged = scored.where(F.col("expected").isin("pico", "valle"))
    ok = F.coalesce(F.col("passes"), F.lit(False)).cast("double")
    return judged.groupBy("year").agg(half_up(100 * F.avg(ok), 1).alias("events_ok_pct"))


# Ignored events, the longest event, and the least window length by price class.
IGNORED_EVENT = "festivo nacional"
MAX_EVENT_DAYS = 45
MIN_LENGTH = {"bf": 7, "rebajas": 25, "navidad": 10, "verano": 7}


def price_windows_from_events(windows: DataFrame) -> DataFrame:
    """Observed event windows to price windows: classify, merge by id, pad to the least length on both sides."""
    kept = windows.where(~F.contains(F.lower("event"), F.lit(IGNORED_EVENT)))
    kept = kept.where(F.datediff("end", "start") + 1 <= MAX_EVENT_DAYS).withColumns(P.price_class("event"))
    merged = kept.groupBy(F.concat_ws("_", "id_prefix", F.col("year").cast("string")).alias("id"), "id_prefix", "scope_values").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.avg("discount").alias("discount")
    )
    least = None
    for prefix, n in MIN_LENGTH.items():
        hit = F.col("id_prefix") == prefix
        least = F.when(hit, n) if least is None else least.when(hit, n)
    pad = F.greatest(least.otherwise(0) - (F.datediff("end", "start") + 1), F.lit(0))
    left = F.floor(pad / 2).cast("int")
    return merged.withColumn("_pad", pad.cast("int")).select(
        "id", F.date_sub("start", left).alias("start"), F.date_add("end", F.col("_pad") - left).alias("end"),
        "discount", F.lit("cluster").alias("scope_type"), "scope_values",
    )


def price_window_preflight(
    windows: DataFrame, event_days: DataFrame, outlier_days: DataFrame, clusters: list[int], product_cluster: DataFrame | None = None
) -> DataFrame:
    """Per window and cluster: expected multiplier, overlap with events, outlier days inside, cap and floor checks."""
    days = expand_windows_daily(windows.select("id", "start", "end"), date="date")
    ev = event_days.select("date").distinct().withColumn("_e", F.lit(1))
    out = outlier_days.select("date").distinct().withColumn("_o", F.lit(1))
    counted = days.join(ev, "date", "left").join(out, "date", "left").groupBy("id").agg(
        F.count("_e").alias("overlap_days"), F.count("_o").alias("outliers_inside")
    )
    j = scope_window_join(windows, clusters, product_cluster).join(counted, "id")
    m = F.pow(1 + F.col("discount"), P.elasticity("cluster_id"))
    cap = P.multiplier_cap("cluster_id", F.col("overlap_days") > 0)
    return j.select(
        "id", "cluster_id", "start", "end", (F.datediff("end", "start") + 1).alias("days"), "discount",
        m.alias("m_expected"), (m - 1).alias("lift_expected"), "overlap_days", "outliers_inside", cap.alias("cap_limit"),
        F.when(m <= cap, "OK").otherwise("REVISAR").alias("cap_ok"), F.when(m >= P.FLOOR, "OK").otherwise("REVISAR").alias("floor_ok"),
    )


def price_multiplier_calendar(
    windows: DataFrame, event_days: DataFrame, clusters: list[int], product_cluster: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Multipliers by (date, cluster) and by (date, product); of overlapping windows the largest effect stays."""
    ev = event_days.select("date").distinct().withColumn("_e", F.lit(True))

    def resolved(targets: DataFrame, key: str) -> DataFrame:
        daily = expand_windows_daily(targets, date="date").join(ev, "date", "left")
        m = P.elasticity_multiplier("discount", "cluster_id", F.coalesce("_e", F.lit(False)))
        rows = daily.select("date", key, m.alias("m"), "id").distinct()
        return highest_lift_window_wins(rows, ["date", key])

    by_cluster = windows.where(F.lower("scope_type") != "product_id")
    return (
        resolved(scope_window_join(by_cluster, clusters), "cluster_id"),
        resolved(scope_product_join(windows, product_cluster), "product_id"),
    )


def apply_price_effect(base: DataFrame, by_cluster: DataFrame, by_product: DataFrame, product_cluster: DataFrame) -> DataFrame:
    """Demand and price after the price windows. Columns: product_id, date, qty, cluster_id?, price, is_outlier.

    A missing cluster is taken from the product's most frequent one, else from the most frequent of all.
    """
    mode = mode_per_product(product_cluster, "product_id", "cluster_id").withColumnRenamed("cluster_id", "_pc")
    known = base.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(one().alias("_n"))
    overall = known.agg(F.max_by("cluster_id", F.struct("_n", -F.col("cluster_id"))))
    filled = base.join(mode, "product_id", "left")
    cluster = F.coalesce(F.col("cluster_id"), F.col("_pc"), overall.scalar(), F.lit(0)).cast("int")
    filled = filled.withColumn("cluster_id", cluster).drop("_pc")
    j = price_multiplier_priority_join(filled, by_product, by_cluster, "product_id", "cluster_id", "date")
    m = F.when((F.col("multiplier") > 1) & (F.coalesce("is_outlier", F.lit(0)) == 1), 1.0).otherwise(F.col("multiplier"))
    j = j.withColumn("multiplier", m)
    factor = P.effective_price_factor("multiplier", "cluster_id")
    return j.withColumn("qty_adj", F.col("qty") * F.col("multiplier")).withColumn("price_factor", factor).withColumn(
        "price_virtual", F.col("price") * F.col("price_factor")
    )


def external_factor_windows(windows: DataFrame) -> DataFrame:
    """Events as factor windows with the default lift of their class, each window once."""
    w = windows.withColumns(P.factor_class("event"))
    wid = F.concat_ws("_", "factor_type", F.col("year").cast("string"), F.col("start").cast("string"))
    return w.groupBy("factor_type", "start", "end", "lift", "notes").agg(F.min(wid).alias("id"))


def merge_factor_calendars(frames: list[DataFrame]) -> DataFrame:
    """Windows of several sources to days, the highest lift per day and factor, and back to windows."""
    daily = None
    for w in frames:
        d = expand_windows_daily(w.select("start", "end", "factor_type", "lift")).select("date", "factor_type", "lift")
        daily = d if daily is None else daily.unionByName(d)
    top = daily.groupBy("date", "factor_type").agg(F.max("lift").alias("lift"))
    wins = gaps_and_islands(top, ["factor_type", "lift"])
    return wins.withColumn("id", F.concat_ws("_", "factor_type", F.col("start").cast("string")))


# Column of each factor type, and the columns that are multiplied.
FACTOR_COLUMNS = {
    "inflacion_cpi": "M_inflation", "marketing_push": "M_promo", "season_extra": "M_seasonExtra",
    "competition_high": "M_competition", "agosto_nonprice": "M_agosto_nonprice",
}


def apply_external_factors(demand: DataFrame, windows: DataFrame, base_col: str = "qty") -> DataFrame:
    """One multiplier column per factor by date, their product and the names of those applied."""
    days = expand_windows_daily(windows)
    wide = days.groupBy("date").agg(
        *[F.coalesce(F.max(F.when(F.col("factor_type") == k, F.col("lift"))), F.lit(1.0)).alias(c) for k, c in FACTOR_COLUMNS.items()]
    )
    cols = list(FACTOR_COLUMNS.values())
    j = demand.join(wide, "date", "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in cols})
    return j.withColumn("final", F.col(base_col) * P.factor_product(cols)).withColumn("applied", P.factors_applied(cols))


def _uniform(text: Column, part: int) -> Column:
    """A number in (0, 1) from eight hex digits of the hash."""
    piece = F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("double")
    return (piece + 1) / 4294967297.0


def noise_augment(df: DataFrame, value: str, cluster: str, keys: list[str], seed: int = 2025) -> DataFrame:
    """Mean-preserving lognormal noise by the cluster's sigma, rounded up.

    The normal draw comes from a hash of the keys and the seed: the same on every run and in any order.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    z = F.sqrt(-2 * F.log(_uniform(text, 0))) * F.cos(2 * math.pi * _uniform(text, 1))
    sigma = P.by_cluster(cluster, P.NOISE_SIGMA, P.DEFAULT_SIGMA)
    factor = F.exp(-0.5 * sigma * sigma + sigma * z)
    return df.withColumn("noised", F.ceil(F.greatest(F.lit(0.0), F.col(value) * factor)).cast("double"))


def noise_factors(df: DataFrame, cluster: str, final: str, noised: str, target: float = 0.22, eps: float = 1e-9) -> DataFrame:
    g = df.groupBy(cluster).agg(F.avg(final).alias("mean_final"), F.avg(noised).alias("mean_noised"))
    g = g.withColumn("noise_pct", (F.col("mean_noised") - F.col("mean_final")) / (F.col("mean_final") + eps))
    return g.withColumn("k", F.coalesce(F.least(F.lit(1.0), F.lit(target) / F.nullif(F.col("noise_pct") + eps, F.lit(0.0))), F.lit(1.0)))


def noise_shrink_by_cluster(df: DataFrame, cluster: str, final: str, noised: str, target: float = 0.22) -> DataFrame:
    """Only the noise is shrunk, by one factor per cluster; never below 0."""
    k = noise_factors(df, cluster, final, noised, target).select(cluster, "k")
    adj = F.greatest(F.col(final) + F.coalesce("k", F.lit(1.0)) * (F.col(noised) - F.col(final)), F.lit(0.0))
    return df.join(k, cluster, "left").withColumn("adjusted", adj)


def window_alignment_scores(effect_days: DataFrame, event_days: DataFrame, tolerance: int = 3) -> DataFrame:
    """Precision, recall and F1 of days with an effect against event days within the tolerance.

    Both sides are distinct calendar days, widened to ``2 * tolerance + 1`` days and joined by equality.
    """
    e = effect_days.select("date").distinct()
    v = event_days.select("date").distinct()

    def near(df: DataFrame) -> DataFrame:
        wide = df.select(F.explode(F.sequence(F.date_sub("date", tolerance), F.date_add("date", tolerance), F.expr("interval 1 day"))).alias("date"))
        return wide.distinct()

    hits = e.join(near(v), "date", "left_semi").agg(one().alias("n"))
    found = v.join(near(e), "date", "left_semi").agg(one().alias("n"))
    ne, nv = e.agg(one().alias("n")), v.agg(one().alias("n"))
    row = hits.select(F.col("n").alias("_h"), found.scalar().alias("_f"), ne.scalar().alias("_e"), nv.scalar().alias("_v"))
    p = F.col("_h") / F.nullif(F.col("_e"), F.lit(0))
    r = F.col("_f") / F.nullif(F.col("_v"), F.lit(0))
    out = row.select(p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def seasonal_reweight_forecast(forecast: DataFrame, history: DataFrame, date: str = "date", y: str = "y_pred", qty: str = "qty") -> DataFrame:
    """Forecast times (month factor over 1/12), rescaled so that the total stays.

    Month totals of the forecast are one row per month; the rescaling factor comes from them.
    """
    factors = month_product_share(history, date, qty).select("month", (F.col("factor") * 12).alias("_w"))
    monthly = forecast.groupBy(F.month(date).alias("month")).agg(F.sum(y).alias("_t")).join(factors, "month", "left")
    w = F.coalesce("_w", F.lit(1.0))
    scale = monthly.agg((F.sum("_t") / F.nullif(F.sum(F.col("_t") * w), F.lit(0.0))).alias("s"))
    j = forecast.withColumn("month", F.month(date)).join(factors, "month", "left")
    return j.withColumn("y_seasonal", F.col(y) * w * F.coalesce(scale.scalar(), F.lit(1.0))).drop("_w", "month")


def reweight_control(df: DataFrame, date: str = "date", y: str = "y_pred", adjusted: str = "y_seasonal") -> DataFrame:
    """Totals before and after by month, with a TOTAL row."""
    m = df.select(F.month(date).cast("string").alias("month"), y, adjusted)
    r = m.rollup("month").agg(F.sum(y).alias("before"), F.sum(adjusted).alias("after"), F.grouping("month").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("month")).alias("month"), "before", "after")


def scenario_factors(metrics: DataFrame, cluster: str, wape_pct: str, scenario: str, floor: float = 0.0) -> DataFrame:
    w = F.avg(wape_pct) / 100
    if scenario == "optimista":
        return metrics.groupBy(cluster).agg((1 + w).alias("factor"))
    if scenario == "pesimista":
        return metrics.groupBy(cluster).agg(F.greatest(1 - w, F.lit(floor)).alias("factor"))
    raise ValueError(scenario)


def apply_scenario(baseline: DataFrame, factors: DataFrame, cluster: str, y: str) -> DataFrame:
    f = factors.select(cluster, "factor")
    return baseline.join(f, cluster, "left").withColumn("y_scenario", F.col(y) * F.coalesce("factor", F.lit(1.0)))


def scenario_control(applied: DataFrame, cluster: str, y: str) -> DataFrame:
    """Totals by cluster before and after, the variation and the rows without a factor."""
    g = applied.groupBy(cluster).agg(
        one().alias("rows"), F.sum(y).alias("base_total"), F.sum("y_scenario").alias("scenario_total"), count_if(F.col("factor").isNull()).alias("without_factor")
    )
    return g.withColumn("variation_pct", 100 * (F.col("scenario_total") / F.nullif(F.col("base_total"), F.lit(0.0)) - 1))


def what_if_price_promo_event(forecast: DataFrame, cases: DataFrame, y: str = "y_pred") -> DataFrame:
    """Totals per product and case. ``cases``: case, price_pct, elasticity, promo_pct, event_pct.

    Totals are summed first, so each case multiplies one row per product.
    """
    total = forecast.groupBy("product_id").agg(F.sum(y).alias("base"))
    rows = cases.agg(F.sort_array(F.collect_list(F.struct("case", "price_pct", "elasticity", "promo_pct", "event_pct"))))
    each = total.withColumn("c", F.explode(rows.scalar()))
    price = F.pow(F.greatest(F.lit(0.01), 1 + F.col("c.price_pct")), F.col("c.elasticity"))
    m = price * (1 + F.col("c.promo_pct")) * (1 + F.col("c.event_pct"))
    out = each.select("product_id", F.col("c.case").alias("case"), "base", F.greatest(F.col("base") * m, F.lit(0.0)).alias("what_if"))
    return out.withColumn("delta_pct", 100 * (F.col("what_if") / F.nullif(F.col("base"), F.lit(0.0)) - 1))
