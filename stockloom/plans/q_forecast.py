"""Queries over splits, simple forecasts, error measures and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import aggregates as A
from stockloom.operators import features as X
from stockloom.operators import forecast as M
from stockloom.plans.bindings import CTES
from stockloom.plans.registry import query
from stockloom.session import written

_SPLIT = "CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) = 2000 THEN 'val' ELSE 'test' END"


@query("temporal_split", f"SELECT *, {_SPLIT} AS split FROM demand", ctes="demand", doubles="qty")
def _(t):
    return M.temporal_split(t.demand, "date", 1999)


CTES["snaive"] = (
    "cluster_days",
    """SELECT a.cluster_id, a.date, a.qty AS y_true, coalesce(p.qty, CASE WHEN strftime(a.date, '%m-%d') = '02-29' THEN
       (SELECT avg(qty) FROM cluster_days x WHERE x.cluster_id = a.cluster_id AND x.date IN (DATE '1999-02-28', DATE '1999-03-01')) END) AS y_pred
       FROM cluster_days a LEFT JOIN (SELECT cluster_id, strftime(date, '%m-%d') AS k, qty FROM cluster_days WHERE year(date) = 1999) p
       ON p.cluster_id = a.cluster_id AND p.k = strftime(a.date, '%m-%d') WHERE year(a.date) = 2000""",
)


@query("seasonal_naive_mmdd", "SELECT * FROM snaive", ctes="snaive", doubles="y_true y_pred")
def _(t):
    return M.seasonal_naive_mmdd(t.cluster_days, 2000)


@query(
    "seasonal_naive_future",
    "SELECT cluster_id, CAST(date + INTERVAL 12 MONTH AS DATE) AS date, qty AS y_pred FROM cluster_days WHERE year(date) = 2000 AND strftime(date, '%m-%d') <> '02-29'",
    ctes="cluster_days",
    doubles="y_pred",
)
def _(t):
    return M.seasonal_naive_future(t.cluster_days, 2001)


@query(
    "seasonal_naive_tile",
    """SELECT h.cluster_id, h.date, p.qty AS y_pred FROM (SELECT cluster_id, date, (row_number() OVER (PARTITION BY cluster_id ORDER BY date) - 1) % 7 AS i FROM cluster_days WHERE year(date) = 2000) h
       LEFT JOIN (SELECT cluster_id, qty, 7 - row_number() OVER (PARTITION BY cluster_id ORDER BY date DESC) AS i FROM cluster_days WHERE year(date) <= 1999) p ON p.cluster_id = h.cluster_id AND p.i = h.i""",
    ctes="cluster_days",
    doubles="y_pred",
)
def _(t):
    d = t.cluster_days
    return M.seasonal_naive_tile(d.where(F.year("date") <= 1999), d.where(F.year("date") == 2000).select("cluster_id", "date"), 7)


CTES["naives"] = (
    "cluster_days",
    """SELECT v.cluster_id, v.date, v.qty, 'A' AS split, l.y_last, coalesce(g.qty, l.y_last) AS y_lag FROM cluster_days v
       JOIN (SELECT cluster_id, arg_max(qty, date) AS y_last FROM cluster_days WHERE year(date) <= 1998 GROUP BY cluster_id) l USING (cluster_id)
       LEFT JOIN cluster_days g ON g.cluster_id = v.cluster_id AND g.date = v.date - 7 AND year(g.date) <= 1998 WHERE year(v.date) = 1999
       UNION ALL SELECT v.cluster_id, v.date, v.qty, 'B', l.y_last, coalesce(g.qty, l.y_last) FROM cluster_days v
       JOIN (SELECT cluster_id, arg_max(qty, date) AS y_last FROM cluster_days WHERE year(date) <= 1999 GROUP BY cluster_id) l USING (cluster_id)
       LEFT JOIN cluster_days g ON g.cluster_id = v.cluster_id AND g.date = v.date - 7 AND year(g.date) <= 1999 WHERE year(v.date) = 2000""",
)


@query("naive_last_and_lag", "SELECT cluster_id, date, qty, y_last, y_lag FROM naives WHERE split = 'B'", ctes="naives", doubles="qty y_last y_lag")
def _(t):
    d = t.cluster_days
    return M.naive_last_and_lag(d.where(F.year("date") <= 1999), d.where(F.year("date") == 2000), 7)


CTES["bt"] = (
    "naives",
    """SELECT model, cluster_id, split, count(*) AS n, avg(abs(y - p)) AS mae, 100 * sum(abs(y - p)) / sum(abs(y)) AS wape, 100 * avg(2 * abs(y - p) / (abs(y) + abs(p))) AS smape FROM (
       SELECT 'naive_last' AS model, cluster_id, split, qty AS y, y_last AS p FROM naives UNION ALL SELECT 'naive_lag', cluster_id, split, qty, y_lag FROM naives) GROUP BY model, cluster_id, split""",
)


@query("backtest_splits", "SELECT * FROM bt", ctes="bt", doubles="mae wape smape")
def _(t):
    return M.backtest_splits(t.cluster_days, [("A", 1998), ("B", 1999)])


@query("backtest_summary", "SELECT model, split, avg(mae) AS mae, avg(wape) AS wape, avg(smape) AS smape FROM bt GROUP BY model, split", ctes="bt", doubles="mae wape smape")
def _(t):
    return M.backtest_summary(M.backtest_splits(t.cluster_days, [("A", 1998), ("B", 1999)]))


_MET = {
    "fraction": ("sum(e) / greatest(sum(abs(y_true)), 1e-8)", "avg(2 * e / greatest(s, 1e-8))"),
    "percent_eps": ("sum(e) / (sum(abs(y_true)) + 1e-8)", "200 * avg(e / (s + 1e-8))"),
    "percent": ("100 * sum(e) / sum(abs(y_true))", "100 * avg(CASE WHEN s <> 0 THEN 2 * e / s END)"),
}


@query(
    "forecast_metrics",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variant, CASE WHEN grouping(c) = 1 THEN '__GLOBAL__' ELSE c END AS cluster_id, count(*) AS n, avg(e) AS mae, {w} AS wape, {s} AS smape FROM (SELECT CAST(cluster_id AS VARCHAR) AS c, *, abs(y_true - y_pred) AS e, abs(y_true) + abs(y_pred) AS s FROM snaive) GROUP BY ROLLUP (c)"
        for v, (w, s) in _MET.items()
    ),
    ctes="snaive",
    doubles="mae wape smape",
)
def _(t):
    p = written(M.seasonal_naive_mmdd(t.cluster_days, 2000))  # the three variants read it
    out = None
    for v in _MET:
        m = M.forecast_metrics(p, "cluster_id", "y_true", "y_pred", v).withColumn("variant", F.lit(v))
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "future_matrix_status_quo",
    """SELECT product_id, cluster_id, price, 0.0::DOUBLE AS m_promo, d.date, CAST(isodow(d.date) - 1 AS INTEGER) AS dow, CAST(month(d.date) AS INTEGER) AS month FROM (
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM demand_clustered) WHERE rn = 1)
       CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2002-01-01', DATE '2002-01-31', INTERVAL 1 DAY)) AS DATE) AS date) d""",
    ctes="demand_clustered",
    doubles="price m_promo",
)
def _(t):
    h = t.demand_clustered.withColumns({"m_promo": F.lit(1.1), "dow": F.lit(0), "month": F.lit(0)})
    return M.future_matrix_status_quo(h, ["cluster_id", "product_id"], ["price", "m_promo", "dow", "month"], "2002-01-01", "2002-01-31")


@query(
    "validate_predictions",
    """SELECT count(*) AS rows, 0::BIGINT AS nulls, 0::BIGINT AS negatives, count(*) FILTER (date < DATE '2001-02-01') AS out_of_range, 0::BIGINT AS duplicates, count(*) FILTER (date < DATE '2001-02-01') = 0 AS ok FROM forecast""",
    ctes="forecast",
)
def _(t):
    return M.validate_predictions(t.forecast, ["product_id", "date"], "y_pred", "date", "2001-02-01", "2001-12-31")


@query(
    "unify_model_metrics",
    """SELECT c.cluster_id, m.model, m.ord, b.mae, b.wape, b.smape, CASE WHEN b.mae IS NULL THEN 'missing' WHEN m.model = 'SARIMAX' THEN 'failed' ELSE 'ok' END AS status
       FROM (SELECT DISTINCT cluster_id FROM bt) c CROSS JOIN (VALUES ('SeasonalNaive', 0), ('HoltWinters', 1), ('SARIMAX', 2)) m(model, ord)
       LEFT JOIN bt b ON b.cluster_id = c.cluster_id AND b.split = 'B' AND b.model = CASE m.model WHEN 'SeasonalNaive' THEN 'naive_lag' WHEN 'SARIMAX' THEN 'naive_last' END""",
    ctes="bt",
    doubles="mae wape smape",
)
def _(t):
    b = M.backtest_splits(t.cluster_days, [("A", 1998), ("B", 1999)]).where("split = 'B'")
    name = F.when(F.col("model") == "naive_lag", "SeasonalNaive").otherwise("SARIMAX_failed(1,0,1)")
    return M.unify_model_metrics(b.withColumn("model", name))


@query(
    "prepare_cluster_series",
    f"""SELECT cluster_id, date, qty, price, coalesce(lag(price, 1) OVER w, 0) AS price_lag1, coalesce(lag(price, 7) OVER w, 0) AS price_lag7, {_SPLIT} AS split FROM (
        SELECT cluster_id, date, qty, (p - avg(p) OVER c) / stddev_pop(p) OVER c AS price FROM (SELECT cluster_id, date, sum(qty) AS qty, avg(price) AS p FROM demand_clustered GROUP BY cluster_id, date) WINDOW c AS (PARTITION BY cluster_id))
        WINDOW w AS (PARTITION BY cluster_id ORDER BY date)""",
    ctes="demand_clustered",
    doubles="qty price price_lag1 price_lag7",
)
def _(t):
    return M.prepare_cluster_series(t.demand_clustered, ["price"], 1999, [1, 7])


FEATS = ["d_total", "d_mean", "d_std", "p95", "median", "cv"]


def scaled_features(t):
    """Standardised product features with the simulated cluster of the product."""
    f = A.product_features(t.demand).na.fill(0.0).withColumn("cluster_id", (F.col("product_id") % 4).cast("int"))
    return X.standard_scale(f, FEATS).select("product_id", "cluster_id", *FEATS)


CTES["feats"] = (
    "demand",
    "SELECT product_id, sum(qty) AS d_total, avg(qty) AS d_mean, coalesce(stddev_samp(qty), 0) AS d_std, quantile_cont(qty, 0.95) AS p95, median(qty) AS median, coalesce(stddev_samp(qty) / avg(qty), 0) AS cv FROM demand GROUP BY product_id",
)
CTES["scaled"] = (
    "feats",
    "SELECT product_id, CAST(product_id % 4 AS INTEGER) AS cluster_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in FEATS) + " FROM feats",
)


@query("standard_scale", "SELECT * FROM scaled", ctes="scaled", doubles=" ".join(FEATS))
def _(t):
    return scaled_features(t)


_LAG = ", ".join(f"lag(qty, {n}) OVER w AS qty_lag{n}" for n in (1, 7, 14)) + ", " + ", ".join(
    f"CASE WHEN count(qty) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {m} THEN avg(qty) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS qty_roll{n}" for n, m in ((7, 5), (28, 17))
)


@query(
    "ml_feature_table",
    f"""SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS weekofyear, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM (
        SELECT product_id, cluster_id, date, qty, {_LAG} FROM demand_clustered WINDOW w AS (PARTITION BY cluster_id, product_id ORDER BY date)) WHERE qty_lag14 IS NOT NULL AND qty_roll28 IS NOT NULL""",
    ctes="demand_clustered",
    doubles="qty qty_lag1 qty_lag7 qty_lag14 qty_roll7 qty_roll28",
)
def _(t):
    d = t.demand_clustered.drop("price")
    return X.ml_feature_table(d, ["cluster_id", "product_id"], "date", ["qty"], [1, 7, 14], [7, 28])
