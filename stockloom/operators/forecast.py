"""Splits, simple forecasts, error measures and prediction tables.

Forecasts by cluster work on cluster-days: at most one row per cluster and calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import dates as D
from stockloom.operators.aggregates import count_if, demand_cluster_day, one
from stockloom.operators.windows import lag_features, latest_row_per_key, z_scale_per_cluster


def temporal_split(df: DataFrame, date: str, train_until: int) -> DataFrame:
    """train up to a year, val in the next one, test after it."""
    y = F.year(date)
    label = F.when(y <= train_until, "train").when(y == train_until + 1, "val").otherwise("test")
    return df.withColumn("split", label)


def seasonal_naive_mmdd(series: DataFrame, year: int, cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """Same month and day of the year before. A missing 02-29 is the mean of 02-28 and 03-01, or the one present."""
    mmdd = D.month_day("date").alias("_k")
    prev = series.where(F.year("date") == year - 1).groupBy(cluster, mmdd).agg(F.avg(y).alias("_p"))
    leap = prev.groupBy(cluster).agg(
        F.max((F.col("_k") == "02-29").cast("int")).alias("_has"),
        F.avg(F.when(F.col("_k").isin("02-28", "03-01"), F.col("_p"))).alias("_p"),
    )
    made = leap.where("_has = 0 and _p is not null").select(cluster, F.lit("02-29").alias("_k"), "_p")
    actual = series.where(F.year("date") == year).select(cluster, "date", F.col(y).alias("y_true"), mmdd)
    return actual.join(prev.unionByName(made), [cluster, "_k"], "left").select(cluster, "date", "y_true", F.col("_p").alias("y_pred"))


def seasonal_naive_future(series: DataFrame, year: int, cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """The last year moved to a year without truth; 02-29 is left out where the year has none."""
    prev = series.where(F.year("date") == year - 1)
    moved = D.relabel_year("date", year)
    kept = prev.where(D.month_day("date") == D.month_day(moved))
    return kept.select(cluster, moved.alias("date"), F.col(y).alias("y_pred"))


def seasonal_naive_tile(series: DataFrame, horizon: DataFrame, season: int, cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """The last ``season`` values repeated over the horizon, in date order."""
    back = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("date")))
    last = series.withColumn("_b", back).where(F.col("_b") <= season).select(cluster, (season - F.col("_b")).alias("_i"), F.col(y).alias("y_pred"))
    ahead = F.row_number().over(Window.partitionBy(cluster).orderBy("date")) - 1
    return horizon.withColumn("_i", ahead % season).join(last, [cluster, "_i"], "left").drop("_i")


def naive_last_and_lag(train: DataFrame, val: DataFrame, period: int, cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """Last training value, and the training value ``period`` days earlier with the last one as fall-back."""
    level = train.groupBy(cluster).agg(F.max_by(y, "date").alias("y_last"))
    lagged = train.select(cluster, F.date_add("date", period).alias("date"), F.col(y).alias("_lag"))
    j = val.join(level, cluster, "left").join(lagged, [cluster, "date"], "left")
    return j.withColumn("y_lag", F.coalesce("_lag", "y_last")).drop("_lag")


def _metric_columns(y: Column, p: Column, variant: str, eps: float) -> list[Column]:
    err, size = F.abs(y - p), F.abs(y) + F.abs(p)
    mae = F.avg(err).alias("mae")
    if variant == "fraction":
        wape = F.sum(err) / F.greatest(F.sum(F.abs(y)), F.lit(eps))
        smape = F.avg(2 * err / F.greatest(size, F.lit(eps)))
    elif variant == "percent_eps":
        wape = F.sum(err) / (F.sum(F.abs(y)) + eps)
        smape = 200 * F.avg(err / (size + eps))
    elif variant == "percent":
        wape = 100 * F.sum(err) / F.nullif(F.sum(F.abs(y)), F.lit(0.0))
        smape = 100 * F.avg(F.when(size != 0, 2 * err / size))
    else:
        raise ValueError(variant)
    return [one().alias("n"), mae, wape.alias("wape"), smape.alias("smape")]


def forecast_metrics(df: DataFrame, cluster: str, y_true: str, y_pred: str, variant: str = "fraction", eps: float = 1e-8) -> DataFrame:
    """MAE, WAPE and sMAPE per cluster and for all rows (``__GLOBAL__``); rows without truth do not count."""
    base = df.where(F.col(y_true).isNotNull()).select(F.col(cluster).cast("string").alias(cluster), y_true, y_pred)
    aggs = _metric_columns(F.col(y_true), F.col(y_pred), variant, eps)
    r = base.rollup(cluster).agg(*aggs, F.grouping(cluster).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "__GLOBAL__").otherwise(F.col(cluster)).alias(cluster), "n", "mae", "wape", "smape")


def backtest_splits(series: DataFrame, splits: list[tuple[str, int]], period: int = 7, cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """Naive forecasts over rolling splits (name, last training year), with their errors.

    The splits are rows: each series row is copied into the splits that use it, and all splits are one plan.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(yr).alias("until")) for n, yr in splits])
    copies = series.withColumn("s", F.explode(rows)).select(cluster, "date", y, "s.split", "s.until")
    key = F.concat_ws("|", F.col(cluster).cast("string"), "split")
    train = copies.where(F.year("date") <= F.col("until")).withColumn("_k", key)
    val = copies.where(F.year("date") == F.col("until") + 1).withColumn("_k", key)
    pred = naive_last_and_lag(train.select("_k", "date", y), val.select("_k", "date", cluster, "split", F.col(y).alias("y_true")), period, "_k", y)
    models = F.array(F.struct(F.lit("naive_last").alias("model"), F.col("y_last").alias("p")), F.struct(F.lit("naive_lag").alias("model"), F.col("y_lag").alias("p")))
    long = pred.withColumn("m", F.explode(models)).select(cluster, "split", "y_true", "m.model", "m.p")
    return backtest_metrics(long.withColumnRenamed("p", "y_pred"), cluster)


def backtest_metrics(pred: DataFrame, cluster: str) -> DataFrame:
    """Percent errors per (model, cluster, split)."""
    return pred.groupBy("model", cluster, "split").agg(*_metric_columns(F.col("y_true"), F.col("y_pred"), "percent", 0.0))


def backtest_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model", "split").agg(*[F.avg(c).alias(c) for c in ("mae", "wape", "smape")])


def future_matrix_status_quo(hist: DataFrame, keys: list[str], features: list[str], start: str, end: str, date: str = "date") -> DataFrame:
    """The last row of each key on every day of the horizon; promotions are 0, calendar columns are computed anew."""
    last = latest_row_per_key(hist, keys, date).select(*keys, *features)
    rep = last.withColumn(date, F.explode(D.days_between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    cal = {c: v for c, v in D.calendar_columns(date).items() if c in features}
    promo = {c: F.lit(0.0) for c in features if "promo" in c.lower()}
    return rep.withColumns({**cal, **promo}) if cal or promo else rep


def validate_predictions(df: DataFrame, keys: list[str], y: str, date: str, start: str, end: str) -> DataFrame:
    """One row of violation counts of a prediction table. Missing columns are found before any job runs."""
    missing = [c for c in [*keys, y, date] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    d = F.col(date)
    per = df.groupBy(*keys).agg(
        one().alias("_n"), count_if(F.col(y).isNull() | F.isnan(F.col(y).cast("double"))).alias("_null"),
        count_if(F.col(y) < 0).alias("_neg"), count_if(~d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("_out"),
    )
    row = per.agg(
        F.sum("_n").alias("rows"), F.sum("_null").alias("nulls"), F.sum("_neg").alias("negatives"),
        F.sum("_out").alias("out_of_range"), F.sum(F.col("_n") - 1).alias("duplicates"),
    )
    return row.withColumn("ok", (F.col("nulls") == 0) & (F.col("out_of_range") == 0) & (F.col("duplicates") == 0))


# The models of the unified metrics table, in their order.
EXPECTED_MODELS = ["SeasonalNaive", "HoltWinters", "SARIMAX"]


def unify_model_metrics(metrics: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row per cluster and expected model with its status; computed values are kept as they are."""
    clean = F.when(F.col("model").startswith("SARIMAX"), "SARIMAX").otherwise(F.col("model"))
    failed = F.lower("model").contains("failed")
    m = metrics.select(
        cluster, clean.alias("model"), "mae", "wape", "smape", F.when(failed, "failed").otherwise("ok").alias("status")
    )
    order = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ord")) for i, n in enumerate(EXPECTED_MODELS)]))
    expected = metrics.select(cluster).distinct().withColumn("e", order).select(cluster, "e.model", "e.ord")
    return expected.join(m, [cluster, "model"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def prepare_cluster_series(df: DataFrame, exog: list[str], train_until: int, lags: list[int], cluster: str = "cluster_id", y: str = "qty") -> DataFrame:
    """Cluster-days with standardised exogenous columns, their lags (0 where there is none) and the split label."""
    daily = demand_cluster_day(df, cluster, "date", y, exog)
    scaled = z_scale_per_cluster(daily, cluster, exog)
    lagged = lag_features(scaled, [cluster], "date", exog, lags)
    new = {f"{c}_lag{n}": F.coalesce(f"{c}_lag{n}", F.lit(0.0)) for c in exog for n in lags}
    return temporal_split(lagged.withColumns(new), "date", train_until)
