"""Operators on small hand-made frames with expected rows worked out by hand."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import aggregates as A
from stockloom.operators import calendar as cal
from stockloom.operators import cleaning as C
from stockloom.operators import clustering as K
from stockloom.operators import effects as E
from stockloom.operators import forecast as M
from stockloom.operators import inventory as I
from stockloom.operators import joins as J
from stockloom.operators import outliers as O
from stockloom.operators import prefix as P
from stockloom.operators import similarity as S
from stockloom.operators import stats as ST
from stockloom.operators import windows as W


def d(text):
    return date.fromisoformat(text)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_range_running_total_matches_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 11).alias("v"))
    hot = df.withColumn("k", F.when(F.col("i") < 400, 0).otherwise(F.col("k")))
    got = P.range_running_total(hot, ["k"], [F.col("v").desc(), F.col("i")], F.col("v"), "s")
    from pyspark.sql import Window

    want = hot.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy(F.col("v").desc(), "i")))
    assert rows(got, "k", "i", "s") == rows(want, "k", "i", "s")


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 2, 200), rng.integers(0, 30, 200))]
    got = P.exact_quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", {"a": 0.25, "b": 0.99})
    for r in got.collect():
        x = [v for g, v in data if g == r["g"]]
        assert r["a"] == pytest.approx(np.percentile(x, 25)) and r["b"] == pytest.approx(np.percentile(x, 99))


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert rows(P.average_ranks(df, [], "v"), "v", "rank") == [(1.0, 1.0), (2.0, 2.5), (5.0, 4.0)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, d("2024-01-01"), 5.0, 1), (1, d("2024-01-01"), 7.0, 2), (2, d("2024-01-01"), 1.0, 3)], "product_id int, date date, qty double, line int")
    for how, want in (("mean", 6.0), ("sum", 12.0), ("max", 7.0), ("first", 5.0)):
        assert rows(C.resolve_duplicates(df, ["product_id", "date"], "qty", how, ["line"]), "product_id", "qty") == [(1, want), (2, 1.0)]
    assert rows(W.duplicates_keep_all(df, ["product_id", "date"]), "line") == [(1,), (2,)]


def test_product_with_one_value(spark):
    df = spark.createDataFrame([(1, d("2024-01-01"), 5.0)], "product_id int, date date, qty double")
    assert A.product_features(df).first()["d_std"] is None
    flags = O.mad_outlier_flags(df).first()
    assert not flags["flag_any"] and flags["robust_z"] == 0
    assert O.iqr_outliers(df, "product_id", "qty").first()["is_outlier"] is False


def test_rolling_mean_needs_enough_rows_and_never_sees_the_present(spark):
    df = spark.createDataFrame([(1, d("2024-01-01") + timedelta(i), float(i)) for i in range(8)], "g int, date date, x double")
    got = {r["date"].day: r["x_roll7"] for r in W.rolling_mean_shifted(df, ["g"], "date", ["x"], [7]).collect()}
    assert got[5] is None and got[6] == pytest.approx(2.0) and got[8] == pytest.approx(3.0)


def test_weights_sum_to_one_and_mass_is_kept(spark):
    years = spark.createDataFrame([(2023,), (2024,)], "year int")
    for leap in ("explicit", "redistribute"):
        c = cal.seasonal_calendar(years, leap=leap)
        assert all(abs(r["s"] - 1) < 1e-9 for r in c.groupBy("year").agg(F.sum("weight_norm").alias("s")).collect())
    annual = spark.createDataFrame([(1, 2024, 1000.0), (2, 2023, 0.0)], "product_id int, year int, qty double")
    daily = cal.disaggregate_annual(annual, cal.seasonal_calendar(years), ["product_id", "year"])
    check = cal.mass_conservation_check(daily, annual, ["product_id", "year"]).first()
    assert check["n_broken"] == 0 and check["max_abs_error"] < 1e-6
    bad = cal.seasonal_calendar(years).where("date <> date'2024-02-29'")
    assert {r["year"]: r["errors"] for r in cal.validate_seasonal_calendar(bad).collect()} == {2023: "", 2024: "row_count,missing_days,leap_day,sum_not_one"}


def test_islands_of_windows(spark):
    w = spark.createDataFrame([("a", d("2024-01-01"), d("2024-01-03")), ("a", d("2024-01-04"), d("2024-01-05")), ("a", d("2024-01-07"), d("2024-01-07"))], "f string, start date, end date")
    got = cal.gaps_and_islands(cal.expand_windows_daily(w).select("f", "date").distinct(), ["f"])
    assert rows(got, "start", "end") == [(d("2024-01-01"), d("2024-01-05")), (d("2024-01-07"), d("2024-01-07"))]


def offers(spark, data):
    return spark.createDataFrame(data, "product_id int, supplier_id int, price double, availability double, lead_time int, priority int")


def test_one_preferred_offer_per_product(spark):
    o = offers(spark, [(1, 2, 5.0, 9.0, 3, 1), (1, 1, 5.0, 9.0, 3, 1), (2, 5, None, 1.0, 2, 2), (2, 6, 4.0, 1.0, 2, 2), (3, 7, 1.0, 0.0, 1, 1)])
    assert rows(W.preferred_supplier_stock_first(o), "product_id", "supplier_id") == [(1, 1), (2, 6), (3, 7)]
    assert rows(W.cheapest_supplier(o), "product_id", "supplier_id") == [(1, 1), (2, 6), (3, 7)]
    assert rows(W.repair_single_preferred(o), "product_id", "supplier_id", "priority") == [(1, 1, 1), (1, 2, 2), (2, 5, 2), (2, 6, 1), (3, 7, 1)]


def test_product_window_beats_cluster_and_ties_go_to_the_first_id(spark):
    w = spark.createDataFrame(
        [("b", d("2024-11-29"), d("2024-11-29"), -0.25, "cluster", "1"), ("a", d("2024-11-29"), d("2024-11-30"), -0.25, "global", ""), ("p", d("2024-11-29"), d("2024-11-29"), -0.5, "product_id", "7|99")],
        "id string, start date, end date, discount double, scope_type string, scope_values string",
    )
    pc = spark.createDataFrame([(7, 1), (8, 1)], "product_id bigint, cluster_id int")
    ev = spark.createDataFrame([(d("2024-11-29"),)], "date date")
    c, p = E.price_multiplier_calendar(w, ev, [0, 1], pc)
    assert ("a", 1) in rows(c.where("date = date'2024-11-29'"), "id", "cluster_id")
    base = spark.createDataFrame(
        [(7, d("2024-11-29"), 10.0, None, 2.0, 0), (8, d("2024-11-29"), 10.0, 1, 2.0, 1), (8, d("2024-11-30"), 10.0, 1, 2.0, 0)],
        "product_id bigint, date date, qty double, cluster_id int, price double, is_outlier int",
    )
    got = {(r["product_id"], r["date"].day): r for r in E.apply_price_effect(base, c, p, pc).collect()}
    assert got[(7, 29)]["cluster_id"] == 1 and got[(7, 29)]["multiplier"] == pytest.approx(2.0)
    assert got[(8, 29)]["multiplier"] == 1.0 and got[(8, 30)]["multiplier"] == pytest.approx(4 / 3)
    assert got[(8, 30)]["price_virtual"] == pytest.approx(1.5)


def test_scopes(spark):
    w = spark.createDataFrame([("g", "global", ""), ("c", "cluster", "1|2"), ("e", "cluster", ""), ("p", "product_id", "7"), ("q", "product_id", "99"), ("x", "odd", "5")], "id string, scope_type string, scope_values string")
    pc = spark.createDataFrame([(7, 2)], "product_id bigint, cluster_id int")
    got = J.scope_window_join(w, [0, 1, 2], pc).groupBy("id").agg(F.sort_array(F.collect_list("cluster_id")).alias("c"))
    assert {r["id"]: r["c"] for r in got.collect()} == {"g": [0, 1, 2], "c": [1, 2], "e": [0, 1, 2], "p": [2], "q": [0, 1, 2], "x": [0, 1, 2]}


def ledger_frames(spark):
    inv = spark.createDataFrame([(1, 10), (2, 5)], "product_id bigint, stock bigint")
    lines = spark.createDataFrame([(1, d("2024-01-01"), 1, 6), (1, d("2024-01-01"), 2, 4), (1, d("2024-01-02"), 1, 3), (9, d("2024-01-01"), 1, 1)], "product_id bigint, day date, seq int, qty bigint")
    return inv, lines


def test_running_stock_and_alerts(spark):
    inv, lines = ledger_frames(spark)
    led = W.running_stock_ledger(lines, inv, "product_id", "day", ["day", "seq"], "qty", "stock")
    assert rows(led, "day", "seq", "stock_after") == [(d("2024-01-01"), 1, 4), (d("2024-01-01"), 2, 0), (d("2024-01-02"), 1, -3)]
    subs = spark.createDataFrame([(2, 1)], "product_id bigint, substitute_id bigint")
    al = I.order_alerts(lines, inv, led, subs, "now")
    assert rows(al.groupBy("severity").count()) == [("CRIT", 3), ("WARN", 1)] and al.where("supplier_id is not null").count() == 0
    named = I.order_alerts(lines, inv.withColumn("supplier", F.concat(F.lit("S"), F.col("product_id"))), led, subs, "now")
    assert {r.supplier_id for r in named.where("message like 'Rotura%'").collect()} == {"S1"}
    assert rows(I.apply_customer_orders(inv, lines), "product_id", "stock_new") == [(1, 0), (2, 5)]
    assert rows(I.unmatched_orders(inv, lines)) == [(9, 1)]


def test_purchase_suggestions(spark):
    stock = spark.createDataFrame([(1, -3, 0), (2, 4, 9), (3, 50, 9)], "product_id bigint, stock bigint, rop bigint")
    o = spark.createDataFrame([(1, 1, 2.0, 5.0, 3, 1, 5, 6), (1, 2, 1.0, 5.0, 3, 2, 99, 1), (2, 1, None, 5.0, 3, 1, 2, 0)], "product_id bigint, supplier_id int, price double, availability double, lead_time int, priority int, moq int, multiple int")
    got = rows(I.purchase_suggestions(stock, o), "product_id", "qty", "reason")
    assert got == [(1, 6, "rotura"), (2, 2, "bajo_stock")]


def test_safety_stock_edges(spark):
    items = spark.createDataFrame([(1, 50, 0), (2, 50, 2), (3, 50, 2)], "product_id int, stock bigint, lead_time int")
    cols = ", ".join(f"f{i} double" for i in range(7))
    stats = spark.createDataFrame([(1, 4.0, 1.0, *[1.0] * 7), (2, 4.0, None, *[1.0] * 7)], f"product_id int, mu double, sigma double, {cols}")
    got = {r["product_id"]: r for r in I.reorder_point(I.safety_stock_dynamic(items, stats, "2024-01-01", min_ss=2)).collect()}
    assert got[1]["ss"] == 0 and got[1]["rop"] == 0
    assert got[2]["ss"] == int(np.ceil(1.6449 * 2.0 * np.sqrt(2))) and got[2]["rop"] == 8 + got[2]["ss"] and got[2]["cover_days"] == 12
    assert got[3]["ss"] == 0 and got[3]["cover_days"] == 0


def test_seasonal_naive_leap_day(spark):
    s = [(0, d("2023-02-28"), 4.0), (0, d("2023-03-01"), 6.0), (1, d("2023-02-28"), 3.0), (0, d("2024-02-29"), 1.0), (1, d("2024-02-29"), 1.0), (1, d("2024-03-01"), 1.0)]
    got = rows(M.seasonal_naive_mmdd(spark.createDataFrame(s, "cluster_id int, date date, qty double"), 2024), "cluster_id", "date", "y_pred")
    assert [(c, dd.isoformat(), p) for c, dd, p in got if p is not None] == [(0, "2024-02-29", 5.0), (1, "2024-02-29", 3.0)]
    assert got[2][2] is None


def test_metrics_with_zeros(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (0, 10.0, 5.0)], "cluster_id int, y double, p double")
    m = {r["cluster_id"]: r for r in M.forecast_metrics(df, "cluster_id", "y", "p", "percent").collect()}
    assert m["0"]["mae"] == 2.5 and m["0"]["wape"] == 50.0 and m["__GLOBAL__"]["smape"] == pytest.approx(200 / 3)
    f = M.forecast_metrics(df, "cluster_id", "y", "p").where("cluster_id = '0'").first()
    assert f["smape"] == pytest.approx(1 / 3)


def test_noise_repeats_and_keeps_its_mean(spark):
    df = spark.range(4000).select(F.col("id").alias("product_id"), F.lit(1).alias("cluster_id"), F.lit(1000.0).alias("qty"))
    a = E.noise_augment(df, "qty", "cluster_id", ["product_id"])
    b = E.noise_augment(df.repartition(7), "qty", "cluster_id", ["product_id"])
    assert rows(a, "product_id", "noised") == rows(b, "product_id", "noised")
    assert abs(a.agg(F.avg("noised")).first()[0] - 1000) < 5


def test_reweighted_forecast_keeps_its_total(spark):
    f = spark.createDataFrame([(d(f"2025-{m:02d}-01"), 10.0) for m in range(1, 13)], "date date, y_pred double")
    h = spark.createDataFrame([(d(f"2024-{m:02d}-01"), float(m)) for m in range(1, 13)], "date date, qty double")
    out = E.seasonal_reweight_forecast(f, h)
    assert out.agg(F.sum("y_seasonal")).first()[0] == pytest.approx(120.0)


def test_p_values():
    # With two numerator degrees of freedom the survival function is (1 + 2f/d2)^(-d2/2).
    assert ST.f_survival(4.0, 2, 10) == pytest.approx(1.8**-5, abs=1e-9)
    assert ST.f_survival(1.0, 5, 5) == pytest.approx(0.5, abs=1e-9)
    assert ST.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert ST.bonferroni(0.5, 3) == 1.0


def brute_dbscan(x, eps, m):
    near = [set(np.flatnonzero(((x - p) ** 2).sum(axis=1) <= eps * eps)) for p in x]
    core = {i for i, n in enumerate(near) if len(n) >= m}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo, c = [i], len(set(label.values()))
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = c
                todo += [k for k in near[j] if k in core]
    role = {i: "core" if i in core else "border" if near[i] & core else "noise" for i in range(len(x))}
    return role, label


def test_density_clusters_match_brute_force(spark):
    rng = np.random.default_rng(7)
    # Half of all points sit in one crowded spot.
    x = np.vstack([rng.normal(0, 0.02, (120, 2)), rng.normal(2, 0.4, (80, 2)), rng.uniform(-3, 5, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    role, label = brute_dbscan(x, 0.3, 5)
    got = {r["id"]: r for r in K.dbscan_clusters(df, "id", ["a", "b"], 0.3, 5).collect()}
    assert len(got) == len(x)
    assert {i: r["role"] for i, r in got.items()} == role
    pairs = {(label[i], got[i]["cluster"]) for i in label}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((r["cluster"] == -1) == (r["role"] == "noise") for r in got.values())


def test_name_similarity_with_a_crowded_group(spark):
    data = [(i, "c", "gel limon energetico", 60.0) for i in range(30)] + [(100, "c", "gel limon", 61.0), (101, "c", "barrita coco", 60.0), (102, "c", "gel limon energetico", None), (103, "z", "gel limon energetico", 60.0), (104, "c", "gel limon energetico", 90.0)]
    df = spark.createDataFrame(data, "product_id int, category string, name string, pack double")
    got = S.tfidf_name_similarity(df, "product_id", "category", "name", "pack").collect()
    per = {}
    for r in got:
        per.setdefault(r["product_id"], []).append((r["rank"], r["substitute_id"]))
    assert sorted(per[0]) == [(1, 1), (2, 2), (3, 3)] and sorted(per[2]) == [(1, 0), (2, 1), (3, 3)] and sorted(per[29]) == [(1, 0), (2, 1), (3, 2)]
    assert not {102, 103, 104, 101} & set(per)


def test_name_similarity_in_many_small_tasks_matches_brute_force(spark):
    # One token per word and brand, so weights are easy; half of all products share one name, in many packs.
    rng = np.random.default_rng(11)
    words = [f"{a} {b} {c}" for a in ("gel", "bar", "mix") for b in ("lima", "coco", "mora") for c in ("uno", "dos")]
    data = [(i, "cd"[i % 7 == 0], words[0] if i % 2 else str(rng.choice(words)), float(rng.integers(1, 30))) for i in range(240)]
    df = spark.createDataFrame(data, "product_id int, category string, name string, pack double")
    got = S.tfidf_name_similarity(df, "product_id", "category", "name", "pack", rows=200)
    counts = {w: sum(w in d[2].split() for d in data) for d in data for w in d[2].split()}
    vec = {}
    for name in {d[2] for d in data}:
        v = {w: math.log((1 + len(data)) / (1 + counts[w])) + 1 for w in name.split()}
        vec[name] = {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    want = set()
    for i, c, name, pack in data:
        near = [(-round(sum(x * vec[other].get(w, 0.0) for w, x in vec[name].items()), 9), j) for j, d, other, p in data if j != i and d == c and 0.8 < p / pack < 1.25]
        want |= {(i, j, r) for r, (s, j) in enumerate(sorted(x for x in near if x[0] <= -0.7)[:3], 1)}
    assert {(r.product_id, r.substitute_id, r["rank"]) for r in got.collect()} == want and len(want) > 500


def test_joins_that_make_many_rows_are_dealt_by_the_rows_they_make(spark):
    from stockloom.session import dealt_join

    # 300 rows of one key meet 40 rows of it; 100 other keys meet once.
    a = spark.range(400).selectExpr("if(id < 300, 0, id) AS k", "id AS x")
    b = spark.range(440).selectExpr("if(id < 40, 0, id + 260) AS k", "id AS y").where("k < 400")
    got, tasks = dealt_join(a, b, ["k"], "x", 500)
    want = {(r.k, r.x, r.y) for r in a.join(b, "k").collect()}
    assert {(r.k, r.x, r.y) for r in got.collect()} == want and len(want) == got.count() == 300 * 40 + 100
    assert tasks == len(want) // 500 + 1
    most = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert most < len(want) / 4, most


def test_fuzzy_matches(spark):
    a = spark.createDataFrame([("hidratacion",), ("proteina",), ("zzz",)], "c string")
    b = spark.createDataFrame([("hidratacion",), ("proteinas",), ("cafe",)], "t string")
    got = {r["c"]: (r["suggested"], r["use"]) for r in S.fuzzy_category_match(a, b, "c", "t", chunk=1).collect()}
    assert got["proteina"] == ("proteinas", "SI") and got["zzz"][1] == "REVISAR" and "hidratacion" not in got


def test_subset_share_is_counted_among_unflagged(spark):
    from stockloom.operators.topk import representative_subset

    rows = [(0, i, float(100 - i), 0.1, int(i < 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "cluster int, product_id long, demand double, cv double, is_outlier int")
    got = sorted(r.product_id for r in representative_subset(df, "cluster", "product_id", "demand", "cv", "is_outlier", [0], 0.6).collect())
    assert got == [0, 1, 2, 3, 4, 5, 6, 7]


def test_minor_categories_leave_rows_without_one_alone(spark):
    from stockloom.operators.aggregates import merge_minor_categories

    df = spark.createDataFrame([("a", 1, 60.0), ("b", 2, 40.0), (None, 3, 900.0)], "c string, p long, q double")
    assert sorted(map(str, (r.c for r in merge_minor_categories(df, "c", "p", "q", 0.3, 1).collect()))) == ["None", "a", "b"]


def test_missing_quantity_is_not_a_sale_of_zero(spark):
    from stockloom.operators.cleaning import filter_year_clip_negative

    df = spark.sql("SELECT 1 AS p, DATE '2020-01-01' AS d, q FROM VALUES (CAST(NULL AS DOUBLE)), (-2.0D), (3.0D) AS t(q)")
    assert sorted(r.q for r in filter_year_clip_negative(df, "p", "d", "q", 2020).collect()) == [0.0, 3.0]


def test_safety_stock_rounds_the_daily_mean_up(spark):
    from stockloom.operators.inventory import safety_stock_dynamic

    items = spark.createDataFrame([(1, 2)], "product_id long, lead_time int")
    stats = spark.createDataFrame([(1, 1.2, 0.5, *[1.0] * 7)], "product_id long, mu double, sigma double, " + ", ".join(f"f{d} double" for d in range(7)))
    up = safety_stock_dynamic(items, stats, "2024-01-01").first()
    near = safety_stock_dynamic(items, stats, "2024-01-01", rounding="nearest").first()
    assert (up.mu_day, up.mu_lead, up.ss, near.ss) == (2.0, 4.0, 4, 3)


def test_one_item_and_day_with_most_offers_is_ranked(spark):
    from stockloom.operators.windows import rank_external

    df = spark.range(500).selectExpr("CAST(id % 3 = 0 AS BIGINT) * 7 AS product_id", "id AS substitute_id", "0.7 + id / 5000.0D AS score")
    got = rank_external(df).collect()
    for p in (0, 7):
        own = sorted((r for r in got if r.product_id == p), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and [r.score for r in own] == sorted((r.score for r in own), reverse=True)


def test_p_values():
    from stockloom.operators.stats import chi2_survival, correlation_p, f_survival, normal_two_sided

    assert chi2_survival(5.991465, 2) == pytest.approx(0.05, abs=1e-6) and chi2_survival(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    assert chi2_survival(1.145476, 5) == pytest.approx(0.95, abs=1e-5) and chi2_survival(300.0, 3) < 1e-60
    assert f_survival(4.0, 2, 30) == pytest.approx(0.028834, abs=1e-4) and normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert correlation_p(0.5, 20) == pytest.approx(0.02478, abs=1e-4) and correlation_p(1.0, 9) == 0.0


def test_temporary_tables_are_deleted(spark):
    import os

    from stockloom.session import discard, temporary_tables, written

    with temporary_tables(spark):
        a, b = written(spark.range(3)), written(spark.range(4))
        discard(spark, a)
        assert not os.path.exists(a._written_at.removeprefix("file:")) and b.count() == 4
    assert not os.path.exists(b._written_at.removeprefix("file:"))


def test_long_chains_of_cells_get_one_label(spark):
    from stockloom.operators.clustering import connected_labels

    nodes = spark.range(3000).withColumnRenamed("id", "node")
    links = spark.range(2999).selectExpr("id AS _a", "id + 1 AS _b")
    assert {r.label for r in connected_labels(nodes, links).select("label").distinct().collect()} == {0}
