"""A year of history rebuilt from another, and what is missing in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.operators import calendar as cal
from stockloom.operators import windows as W
from stockloom.operators.aggregates import one


def rebuild_history(rows: DataFrame, product: str, date: str, value: str, year: int, order: list[Column]) -> DataFrame:
    """``product, date, value``: the rows moved into ``year``, the first per day by ``order``, every day of the year.

    Days that nothing was moved to have a null value. A product has as many days as the year, whatever it sold.
    """
    moved = rows.withColumn("_day", D.relabel_year(date, year))
    last = W.keep_first(moved, [product, "_day"], order).select(product, F.col("_day").alias(date), value)
    return cal.calendar_densify(last, product, date, year)


def gap_report(known: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Per series and year of ``known``: ``expected, known, missing, coverage, longest_gap, first_known, last_known``.

    ``longest_gap`` is the longest stretch of days without a row, at the ends of the year too. Rows that repeat a day
    count once, and rows without a date not at all. A series has at most one row per day in a task.
    """
    days = known.where(F.col(date).isNotNull()).select(*keys, F.year(date).alias("year"), date).distinct()
    before = F.lag(date).over(Window.partitionBy(*keys, "year").orderBy(date))
    start, end = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    gaps = days.withColumn("_gap", F.datediff(date, F.coalesce(before, F.date_sub(start, 1))) - 1)
    out = gaps.groupBy(*keys, "year").agg(one().alias("known"), F.max("_gap").alias("_inner"), F.min(date).alias("first_known"), F.max(date).alias("last_known"))
    expected = D.days_in_year("year").cast("long")
    return out.select(
        *keys, "year", expected.alias("expected"), "known", (expected - F.col("known")).alias("missing"), (F.col("known") / expected).alias("coverage"),
        F.greatest("_inner", F.datediff(end, "last_known")).alias("longest_gap"), "first_known", "last_known",
    )


def history_metrics(report: DataFrame) -> DataFrame:
    """Per year of a gap report: series, complete ones, days, the share known, its mean over series, the longest gap."""
    return report.groupBy("year").agg(
        one().alias("series"), F.count_if(F.col("missing") == 0).alias("complete"), F.sum("missing").alias("missing"),
        (F.sum("known") / F.sum("expected")).alias("coverage"), F.avg("coverage").alias("mean_coverage"), F.max("longest_gap").alias("longest_gap"),
    )
