"""Column functions over dates and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_flexible_date(c) -> Column:
    """ISO text with a blank or ``T`` before the time; the time is cut off, bad text is null."""
    text = F.trim(_col(c).cast("string"))
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def relabel_year(date, year) -> Column:
    """Same month and day in another year; 02-29 becomes 02-28 where the year has no leap day."""
    d = _col(date)
    y = F.lit(year) if isinstance(year, int) else _col(year)
    return F.add_months(d, (12 * (y - F.year(d))).cast("int"))


def was_relabelled(date, year) -> Column:
    d = _col(date)
    return F.dayofmonth(d) != F.dayofmonth(relabel_year(d, year))


def days_in_year(year) -> Column:
    return F.dayofyear(F.make_date(_col(year).cast("int"), F.lit(12), F.lit(31)))


def month_day(date) -> Column:
    return F.date_format(_col(date), "MM-dd")


def calendar_columns(date) -> dict[str, Column]:
    d = _col(date)
    return {
        "dow": F.weekday(d),
        "month": F.month(d),
        "weekofyear": F.weekofyear(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def _with(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, so that nested uses do not multiply the expression."""
    return F.transform(F.array(value), fn)[0]


def easter(year) -> Column:
    """Gregorian Easter Sunday by whole-number arithmetic on the year."""

    def div(a, n: int) -> Column:
        return F.floor(a / n).cast("int")

    def moon(y: Column) -> Column:
        c = div(y, 100)
        return (19 * (y % 19) + c - div(c, 4) - div(c - div(c + 8, 25) + 1, 3) + 15) % 30

    def week(y: Column, h: Column) -> Column:
        c = div(y, 100)
        return (32 + 2 * (c % 4) + 2 * div(y % 100, 4) - h - (y % 100) % 4) % 7

    def day(y: Column, h: Column, w: Column) -> Column:
        code = h + w - 7 * div(y % 19 + 11 * h + 22 * w, 451) + 114
        return _with(code, lambda k: F.make_date(y, div(k, 31), (k % 31 + 1).cast("int")))

    y0 = _col(year).cast("int")
    return _with(y0, lambda y: _with(moon(y), lambda h: _with(week(y, h), lambda w: day(y, h, w))))


def nth_weekday(year, month: int, weekday: int, n: int) -> Column:
    """n-th weekday (Monday is 0) of a month."""
    first = F.make_date(_col(year).cast("int"), F.lit(month), F.lit(1))
    ahead = (F.lit(weekday) - F.weekday(first) + 7) % 7
    return F.date_add(first, (ahead + 7 * (n - 1)).cast("int"))


def last_weekday(year, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(_col(year).cast("int"), F.lit(month), F.lit(1)))
    back = (F.weekday(last) - weekday + 7) % 7
    return F.date_sub(last, back.cast("int"))


def black_friday(year, rule: str = "last") -> Column:
    """Last Friday of November (weights) or its fourth Friday (checks); they differ in some years."""
    if rule == "last":
        return last_weekday(year, 11, 4)
    if rule == "fourth":
        return nth_weekday(year, 11, 4, 4)
    raise ValueError(rule)


def cyber_monday(year, rule: str = "last") -> Column:
    return F.date_add(black_friday(year, rule), 3)


def prime_day(year) -> Column:
    """First of the two days: the second Tuesday of July."""
    return nth_weekday(year, 7, 1, 2)


def days_between(start, end) -> Column:
    """Array of all days from ``start`` to ``end``."""
    return F.sequence(_col(start), _col(end), F.expr("interval 1 day"))


def year_days(year) -> Column:
    y = _col(year).cast("int")
    return days_between(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
