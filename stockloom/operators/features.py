"""Feature selection, scaling, principal components and the lagged feature table."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions import dates as D
from stockloom.operators.windows import lag_features, rolling_mean_shifted


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0. The moments are one row."""
    aggs = [f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    m = df.agg(*aggs).select(F.struct(*[f"{k}_{c}" for c in cols for k in "ms"]).alias("m"))
    out = df.withColumn("_m", m.scalar())
    scaled = {
        c: F.when(F.col(f"_m.s_{c}") > 0, (F.col(c) - F.col(f"_m.m_{c}")) / F.col(f"_m.s_{c}")).otherwise(F.lit(0.0)) for c in cols
    }
    return out.withColumns(scaled).drop("_m")


def scale_check(scaled: DataFrame, cols: list[str], tol: float = 1e-6) -> DataFrame:
    """Largest distance of any column's mean from 0 and std from 1."""
    row = scaled.agg(
        F.greatest(*[F.abs(F.avg(c)) for c in cols], F.lit(0.0)).alias("max_mean"),
        F.greatest(*[F.abs(F.stddev_pop(c) - 1) for c in cols], F.lit(0.0)).alias("max_std_gap"),
    )
    return row.withColumn("ok", (F.col("max_mean") < tol) & (F.col("max_std_gap") < tol))


def pca_scores(df: DataFrame, cols: list[str], keep: list[str], target: float = 0.90, min_components: int = 5):
    """(scores, loadings, explained): as many components as reach the target variance, at least the minimum.

    The sign of a component is fixed so that its largest loading is positive.
    """
    ready = VectorAssembler(inputCols=cols, outputCol="_x").transform(standard_scale(df, cols).na.fill(0.0, cols))
    model = PCA(k=len(cols), inputCol="_x", outputCol="_pc").fit(ready)
    share = list(model.explainedVariance)
    total, k = 0.0, 0
    while k < len(share) and (total < target or k < min_components):
        total += share[k]
        k += 1
    mat = model.pc.toArray()
    signs = [1.0 if mat[abs(mat[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array("_pc")
    scores = model.transform(ready).select(*keep, *[(arr[j] * signs[j]).alias(f"PC{j + 1}") for j in range(k)])
    spark = df.sparkSession
    names = [f"PC{j + 1}" for j in range(k)]
    loadings = spark.createDataFrame(
        [(c, *[float(mat[i, j] * signs[j]) for j in range(k)]) for i, c in enumerate(cols)], ["feature", *names]
    )
    explained = spark.createDataFrame([(n, float(share[j])) for j, n in enumerate(names)], ["component", "share"])
    return scores, loadings, explained


def feature_vector(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return df.select(*keep, array_to_vector(arr).alias("features"))


# Name parts of exogenous columns, by priority.
EXOG_PRIORITY = ["price_factor", "price_virtual", "price", "precio", "m_promo", "m_season", "m_competition", "m_inflation", "m_agosto"]


def select_numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    """Numeric columns that are not on the exclusion list, in table order."""
    skip = {c.lower() for c in exclude}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]


def pick_exogenous(columns: list[str], limit: int = 8) -> list[str]:
    """At most ``limit`` columns: those with a priority name part first, then the rest in order."""
    picked: list[str] = []
    for part in EXOG_PRIORITY:
        picked += [c for c in columns if part in c.lower() and c not in picked]
    picked += [c for c in columns if c not in picked]
    return picked[:limit]


def ml_feature_table(
    df: DataFrame, groups: list[str], date: str, cols: list[str], lags: list[int], widths: list[int], calendar: bool = True, drop_incomplete: bool = True
) -> DataFrame:
    """Lags and shifted rolling means per series, calendar columns, rows without full history left out."""
    out = rolling_mean_shifted(lag_features(df, groups, date, cols, lags), groups, date, cols, widths)
    new = [c for c in out.columns if c not in df.columns]
    if calendar:
        out = out.withColumns(D.calendar_columns(date))
    return out.na.drop(subset=new) if drop_incomplete else out
