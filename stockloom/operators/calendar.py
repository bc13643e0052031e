"""Calendars: moving feasts, event days, seasonal weights, windows expanded to days and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import dates as D

# National holidays as (month, day).
HOLIDAYS = [(1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)]

# Expected direction of each event.
EXPECTED = {
    "Rebajas Invierno": "pico", "Rebajas Verano": "pico", "San Valentín": "pico",
    "Black Friday": "pico", "Cyber Monday": "pico", "Prime Day": "pico",
    "Navidad": "pico", "Vuelta al cole": "pico",
    "Agosto": "valle",
    "Semana Santa": "mixto", "Festivo Nacional": "mixto",
}

# Weekday weights, Monday first.
WEEKDAY_WEIGHTS = [0.95, 0.95, 1.0, 1.0, 1.10, 1.10, 1.10]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _fixed(month: int, day: int):
    return lambda y: F.make_date(y, F.lit(month), F.lit(day))


def _span(year: Column, start, end) -> Column:
    return D.days_between(start(year), end(year))


def _days(*makers):
    return lambda y: F.array(*[m(y) for m in makers])


def expected_direction(event: str | Column) -> Column:
    e = F.col(event) if isinstance(event, str) else event
    chain = None
    for name, side in EXPECTED.items():
        chain = F.when(e == name, F.lit(side)) if chain is None else chain.when(e == name, F.lit(side))
    return chain.otherwise("mixto")


def moving_feasts(years: DataFrame, year: str = "year") -> DataFrame:
    y = F.col(year)
    return years.select(
        year,
        D.easter(y).alias("easter"),
        D.nth_weekday(y, 1, 0, 3).alias("blue_monday"),
        D.black_friday(y, "last").alias("black_friday"),
        D.cyber_monday(y, "last").alias("cyber_monday"),
        D.black_friday(y, "fourth").alias("black_friday_fourth"),
        D.prime_day(y).alias("prime_day"),
    )


def real_event_calendar(years: DataFrame, year: str = "year", rule: str = "fourth") -> DataFrame:
    """(event, date, year): the named event days of each year."""
    y = F.col(year).cast("int")

    def easter_minus(n):
        return lambda v: F.date_sub(D.easter(v), n)

    groups = {
        "Festivo Nacional": _days(*[_fixed(m, d) for m, d in HOLIDAYS])(y),
        "Semana Santa": _days(easter_minus(3), easter_minus(2))(y),
        "Rebajas Invierno": _span(y, _fixed(1, 7), _fixed(1, 31)),
        "Rebajas Verano": _span(y, _fixed(7, 1), _fixed(7, 31)),
        "San Valentín": _days(_fixed(2, 14))(y),
        "Black Friday": F.array(D.black_friday(y, rule)),
        "Cyber Monday": F.array(D.cyber_monday(y, rule)),
        "Prime Day": F.array(D.prime_day(y), F.date_add(D.prime_day(y), 1)),
        "Navidad": _span(y, _fixed(12, 20), _fixed(12, 31)),
        "Vuelta al cole": _span(y, _fixed(9, 1), _fixed(9, 15)),
        "Agosto": _span(y, _fixed(8, 1), _fixed(8, 31)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("event"), d.alias("days")) for n, d in groups.items()])
    return (
        years.select(y.alias("year"), F.explode(rows).alias("g"))
        .select(F.col("g.event").alias("event"), F.explode("g.days").alias("date"), "year")
        .distinct()
    )


def default_event_rules(
    years: DataFrame, back_to_school: bool = False, prime: bool = False, year: str = "year"
) -> DataFrame:
    """Weight rules as rows (event, date, multiplier, ord). User rules of the same shape may be unioned.

    ``ord`` is the position of the rule and fixes the order of labels on a shared day.
    """
    y = F.col(year).cast("int")
    e = D.easter(y)
    # Event names and multipliers.
    rules = [
        ("Rebajas Invierno", 1.50, _span(y, _fixed(1, 1), _fixed(1, 15))),
        ("Rebajas Verano", 1.50, _span(y, _fixed(7, 1), _fixed(7, 15))),
        ("San Valentín", 1.80, _days(_fixed(2, 14))(y)),
        ("Navidad", 1.80, _days(_fixed(12, 25))(y)),
        ("Día del Padre", 1.20, _days(_fixed(3, 19))(y)),
        ("Blue Monday", 1.20, F.array(D.nth_weekday(y, 1, 0, 3))),
        ("Black Friday", 3.00, F.array(D.black_friday(y))),
        ("Cyber Monday", 2.00, F.array(D.cyber_monday(y))),
        ("Jueves Santo", 1.20, F.array(F.date_sub(e, 3))),
        ("Viernes Santo", 1.30, F.array(F.date_sub(e, 2))),
        ("Sábado Santo", 1.15, F.array(F.date_sub(e, 1))),
        ("Lunes de Pascua", 1.10, F.array(F.date_add(e, 1))),
    ]
    if back_to_school:
        rules.append(("Vuelta al cole", 1.05, _span(y, _fixed(9, 1), _fixed(9, 15))))
    if prime:
        rules.append(("Amazon Prime Day", 1.20, F.array(D.prime_day(y), F.date_add(D.prime_day(y), 1))))
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("event"), F.lit(m).alias("multiplier"), d.alias("days"), F.lit(i).alias("ord"))
            for i, (n, m, d) in enumerate(rules)
        ]
    )
    return years.select(F.explode(rows).alias("r")).select(
        F.col("r.event").alias("event"),
        F.explode("r.days").alias("date"),
        F.col("r.multiplier").alias("multiplier"),
        F.col("r.ord").alias("ord"),
    )


def default_month_cycle(day: Column) -> Column:
    # Weight by day of the month.
    return F.when(day <= 10, 1.2).when(day <= 20, 1.0).otherwise(0.8)


def seasonal_calendar(
    years: DataFrame,
    rules: DataFrame | None = None,
    leap: str = "explicit",
    normalize: bool = True,
    month_cycle=default_month_cycle,
    weekday_weights: list[float] = WEEKDAY_WEIGHTS,
    year: str = "year",
) -> DataFrame:
    """One row per day of each year with the three weights and their normalised product.

    ``rules`` is a table (event, date, multiplier, ord); by default the built-in rules.
    """
    if leap not in ("explicit", "redistribute"):
        raise ValueError(leap)
    rules = default_event_rules(years, year=year) if rules is None else rules
    labels = F.array_sort(F.collect_list(F.struct("ord", "event")))
    events = rules.groupBy("date").agg(
        F.array_join(F.transform(labels, lambda x: x["event"]), "; ").alias("event"),
        F.product("multiplier").alias("w_event"),
    )
    days = years.select(F.col(year).cast("int").alias("year"), F.explode(D.year_days(year)).alias("date"))
    dow = F.weekday("date")
    weekly = F.array(*[F.lit(float(w)) for w in weekday_weights])[dow]
    leap_day = D.month_day("date") == "02-29"
    is_leap = D.days_in_year("year") == 366
    out = (
        days.join(events, "date", "left")
        .withColumn("month", F.month("date"))
        .withColumn("day", F.dayofmonth("date"))
        .withColumn("weekday", F.array(*[F.lit(n) for n in WEEKDAY_NAMES])[dow])
        .withColumn("event", F.coalesce("event", F.lit("")))
        .withColumn("w_monthly", month_cycle(F.dayofmonth("date")).cast("double"))
        .withColumn("w_weekly", weekly)
        .withColumn("w_event", F.coalesce("w_event", F.lit(1.0)))
        .withColumn("weight", F.col("w_monthly") * F.col("w_weekly") * F.col("w_event"))
        .withColumn("leap_note", F.when(is_leap, leap).otherwise("n/a"))
    )
    if leap == "redistribute":
        out = out.withColumn("weight", F.when(leap_day, 0.0).otherwise(F.col("weight")))
    if normalize:
        # A year holds at most 366 rows, so this window is small whatever the data behind it.
        out = out.withColumn("weight_norm", F.col("weight") / F.sum("weight").over(Window.partitionBy("year")))
    return out


def validate_seasonal_calendar(calendar: DataFrame, tol: float = 1e-9, weight: str = "weight_norm") -> DataFrame:
    """Per year: the counts a calendar must satisfy and the list of violated rules."""
    w = F.col(weight)
    facts = calendar.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("date").alias("n_days"),
        F.max((D.month_day("date") == "02-29").cast("int")).alias("has_leap_day"),
        F.sum((w.isNull() | F.isnan(w)).cast("int")).alias("n_null"),
        F.sum((F.abs(w) == float("inf")).cast("int")).alias("n_inf"),
        F.sum((w < 0).cast("int")).alias("n_negative"),
        F.sum(w).alias("total"),
    )
    expected = D.days_in_year("year")
    checks = [
        ("row_count", F.col("n_rows") != expected),
        ("duplicates", F.col("n_rows") != F.col("n_days")),
        ("missing_days", F.col("n_days") < expected),
        ("leap_day", F.col("has_leap_day") != (expected == 366).cast("int")),
        ("null_weight", F.col("n_null") > 0),
        ("infinite_weight", F.col("n_inf") > 0),
        ("negative_weight", F.col("n_negative") > 0),
        ("sum_not_one", F.coalesce(F.abs(F.col("total") - 1) > tol, F.lit(True))),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return facts.select(
        "year", "n_rows", "n_days", "n_null", "n_negative",
        F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("ok"),
    )


def seasonal_calendar_join(annual: DataFrame, calendar: DataFrame, qty: str = "qty", weight: str = "weight_norm") -> DataFrame:
    """Yearly totals spread over the days of their year."""
    return annual.join(calendar.select("year", "date", weight), "year").withColumn("qty_day", F.col(qty) * F.col(weight))


def mass_conservation_check(
    daily: DataFrame, annual: DataFrame, keys: list[str], qty_day: str = "qty_day", qty: str = "qty", tol: float = 1e-6
) -> DataFrame:
    """Every yearly total against the sum of its days; a total without days counts as a full loss."""
    sums = daily.groupBy(*keys).agg(F.sum(qty_day).alias("_days"))
    gap = F.abs(F.coalesce("_days", F.lit(0.0)) - F.col(qty))
    return annual.join(sums, keys, "left").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max(gap).alias("max_abs_error"),
        F.sum((gap > tol).cast("long")).alias("n_broken"),
    )


def disaggregate_annual(annual: DataFrame, calendar: DataFrame, keys: list[str], qty: str = "qty") -> DataFrame:
    """Daily demand of each yearly total; columns keys + date + qty_day."""
    return seasonal_calendar_join(annual, calendar, qty).select(*keys, "date", "qty_day")


def calendar_densify(demand: DataFrame, product: str, date: str, year: int) -> DataFrame:
    """Every product on every day of the year; days without an observation stay null.

    The days are generated inside each product row, so there is no join between products and days.
    """
    days = demand.select(product).distinct().withColumn(date, F.explode(D.year_days(F.lit(year))))
    return days.join(demand.where(F.year(date) == year), [product, date], "left")


def expand_windows_daily(windows: DataFrame, start: str = "start", end: str = "end", date: str = "date") -> DataFrame:
    """[start, end] as one row per day; a window that ends before it starts has no days."""
    return windows.where(F.col(start) <= F.col(end)).withColumn(date, F.explode(D.days_between(start, end)))


def gaps_and_islands(daily: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Daily rows (distinct per keys and date) as maximal windows of consecutive days.

    A group holds one row per calendar day, so its window is bounded by the length of the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    island = F.date_sub(F.col(date), F.row_number().over(w))
    return (
        daily.select(*keys, date, island.alias("_island"))
        .groupBy(*keys, "_island")
        .agg(F.min(date).alias("start"), F.max(date).alias("end"))
        .drop("_island")
    )


def monthly_windows(span: DataFrame, factor_type: str, lift: float) -> DataFrame:
    """Month-long windows clipped to the one-row ``span`` (start, end)."""
    months = F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("interval 1 month"))
    rows = span.select("start", "end", F.explode(months).alias("m"))
    first = F.greatest("m", "start")
    return rows.select(
        F.concat(F.lit(factor_type + "_"), first.cast("string")).alias("id"),
        first.alias("start"),
        F.least(F.last_day("m"), F.col("end")).alias("end"),
        F.lit(factor_type).alias("factor_type"),
        F.lit(lift).alias("lift"),
        F.lit("monthly").alias("notes"),
    )


def yearly_fixed_windows(
    span: DataFrame, month_days: list[tuple[int, int, int]], factor_type: str, lift: float, notes: str
) -> DataFrame:
    """Windows (month, first day, last day) of every year of the span, clipped to it.

    A day the year does not have (02-29) leaves the window out.
    """
    years = span.select("start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("y"))
    parts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("mab", t)]) for t in month_days])

    def day(d) -> Column:
        text = F.format_string("%04d-%02d-%02d", F.col("y"), F.col("w.m"), d)
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")

    made = years.withColumn("w", F.explode(parts)).select(
        F.col("start").alias("lo"), F.col("end").alias("hi"), day(F.col("w.a")).alias("s"), day(F.col("w.b")).alias("e")
    )
    kept = made.where("s is not null and e is not null and e >= lo and s <= hi")
    first = F.greatest("s", "lo")
    return kept.select(
        F.concat(F.lit(factor_type + "_"), first.cast("string")).alias("id"),
        first.alias("start"),
        F.least("e", "hi").alias("end"),
        F.lit(factor_type).alias("factor_type"),
        F.lit(lift).alias("lift"),
        F.lit(notes).alias("notes"),
    )
