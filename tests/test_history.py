"""Gaps of rebuilt histories, unmatched keys, and roles of the density grid."""

import datetime as dt

from stockloom.operators import aggregates as A
from stockloom.operators import density as N
from stockloom.operators import history as HI
from stockloom.operators import inventory as I
from stockloom.operators import sets as U


def d(text):
    return dt.date.fromisoformat(text)


def test_gaps_at_both_ends_inside_and_in_leap_years(spark):
    rows = [(1, d("2000-01-03")), (1, d("2000-01-03")), (1, d("2000-01-10")), (1, d("2000-12-30")), (1, None), (2, d("1999-12-31")), (2, d("2000-06-01"))]
    got = {(r.p, r.year): r for r in HI.gap_report(spark.createDataFrame(rows, "p int, day date"), ["p"], "day").collect()}
    assert len(got) == 3
    r = got[(1, 2000)]
    assert (r.expected, r.known, r.missing, r.longest_gap, r.first_known, r.last_known) == (366, 3, 363, 354, d("2000-01-03"), d("2000-12-30"))
    assert got[(2, 1999)].longest_gap == 364 and got[(2, 2000)].longest_gap == 213
    m = {r.year: r for r in HI.history_metrics(HI.gap_report(spark.createDataFrame(rows, "p int, day date"), ["p"], "day")).collect()}
    assert (m[2000].series, m[2000].complete, m[2000].missing, m[2000].longest_gap) == (2, 0, 363 + 365, 354)
    full = spark.createDataFrame([(1, d("2001-01-01") + dt.timedelta(days=i)) for i in range(365)], "p int, day date")
    assert [(r.complete, r.coverage, r.longest_gap) for r in HI.history_metrics(HI.gap_report(full, ["p"], "day")).collect()] == [(1, 1.0, 0)]
    assert HI.gap_report(full.limit(0), ["p"], "day").collect() == []


def test_unmatched_categories_suppliers_and_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "b", 5.0), (3, "b", 0.0)], "product_id int, c string, qty double")
    known = spark.createDataFrame([("a",), ("z",)], "c string")
    got = A.category_mismatch_summary(df, known, "c", "product_id", "qty").collect()
    assert [(r.c, r.products, r.demand, r.products_pct, r.demand_pct) for r in got] == [("b", 2, 8.0, 200 / 3, 80.0)]
    assert {(r.c, r.only_in) for r in U.category_set_difference(df, known, "c").collect()} == {("b", "a"), ("z", "b")}
    offers = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "product_id int, supplier_id int")
    report = I.supplier_qc_report(spark.createDataFrame([(1,), (2,), (3,)], "product_id int"), offers, offers.where("product_id = 1"), offers.limit(0))
    assert sorted((r.kind, r.product_id) for r in report.collect()) == [("INFO", 1), ("WARN", 1), ("WARN", 2), ("WARN", 3), ("WARN", 3)]


def test_roles_are_those_of_the_whole_grid(spark):
    rows = [(i, float(i % 7) / 3, float(i % 11) / 4) for i in range(60)] + [(100, 9.0, 9.0), (101, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    args = (df, "id", ["a", "b"], [0.2, 0.4], [2, 4])
    key = lambda r: (r.id, r.eps, r.min_samples, r.role)
    assert set(map(key, N.density_roles(*args).collect())) == set(map(key, N.density_grid(*args).collect()))
