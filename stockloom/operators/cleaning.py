"""Filters, cleaning and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.text import contains_any
from stockloom.operators.aggregates import coverage_by_product
from stockloom.operators.prefix import null_safe
from stockloom.session import written


def is_active(status: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(status))) == "activo", F.lit(False))


def filter_active_products(df: DataFrame, status: str, keep: list[str]) -> DataFrame:
    return df.where(is_active(status)).select(*keep)


def active_summary(df: DataFrame, status: str, product: str) -> DataFrame:
    """Rows and products before and after :func:`filter_active_products`, in one pass."""
    ok = is_active(status)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.sum(ok.cast("long")).alias("rows_after"),
        F.countDistinct(product).alias("products_before"),
        F.countDistinct(F.when(ok, F.col(product))).alias("products_after"),
    )


def drop_null_category(df: DataFrame, col: str) -> DataFrame:
    return df.na.drop(subset=[col])


def null_report(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(col).alias("rows_after"),
        (F.count(F.lit(1)) - F.count(col)).alias("removed"),
    )


def filter_year_clip_negative(df: DataFrame, product: str, date: str, qty: str, year: int) -> DataFrame:
    """Rows of one year with both keys and a quantity; negative quantities become 0."""
    kept = df.where((F.year(date) == year) & F.col(product).isNotNull() & F.col(date).isNotNull() & F.col(qty).isNotNull())
    return kept.withColumn(qty, F.greatest(F.col(qty), F.lit(0.0)))


def remove_negatives(df: DataFrame, col: str, how: str = "clip0") -> DataFrame:
    if how == "clip0":
        return df.withColumn(col, F.when(F.col(col) < 0, F.lit(0.0)).otherwise(F.col(col)))
    if how == "drop":
        return df.where(F.col(col).isNull() | (F.col(col) >= 0))
    raise ValueError(how)


def invalid_rows_with_reason(df: DataFrame, product: str, date: str, qty: str, first: str, last: str) -> DataFrame:
    """Rows that break a rule, with their reasons in fixed order."""
    d, q = F.col(date), F.col(qty)
    # Texts of the reasons.
    reasons = [
        (d.isNull(), "Date NaN; "),
        (q.isNull(), "Demand_Day NaN; "),
        (F.col(product).isNull(), "Product_ID NaN; "),
        (q < 0, "Demand_Day < 0; "),
        ((d < F.lit(first).cast("date")) | (d > F.lit(last).cast("date")), "Date fuera de rango; "),
    ]
    text = F.concat(*[F.when(bad, name).otherwise("") for bad, name in reasons])
    return df.withColumn("reason", text).where(F.col("reason") != "")


def problem_case_rules(
    df: DataFrame,
    product: str,
    date: str,
    qty: str,
    status: str,
    category: str,
    tie: list[Column],
    first: str,
    last: str,
    min_coverage: float,
    scope: str = "overall",
    iqr: bool = False,
) -> DataFrame:
    """Every row with the rule of the ordered cascade that removes it in ``rule``, null for clean rows.

    Each rule sees only what the rules before it left: non-active, invalid, null category, repeated
    key (the first row in ``tie`` order stays), zero total, low coverage and optionally IQR outliers.
    """
    d, q, rule = F.col(date), F.col(qty), F.col("rule")
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    yes = F.lit(True)
    invalid = d.isNull() | q.isNull() | F.col(product).isNull() | (q < 0) | (d < lo) | (d > hi)
    row_rule = (
        F.when(F.coalesce(~is_active(status), yes), "estado_no_activo")
        .when(F.coalesce(invalid, yes), "valores_invalidos").when(F.col(category).isNull(), "categoria_nula")
    )
    # Rows that are out already are spread by their content: many of them may share one key, null for instance.
    spread = F.when(rule.isNotNull(), F.xxhash64(*df.columns))
    nth = F.row_number().over(Window.partitionBy(product, date, rule.isNotNull(), spread).orderBy(*tie))
    repeated = F.when(rule.isNull() & (nth > 1), "duplicados_product_date").otherwise(rule)
    # The product rules read these rows several times, so they are kept and not worked out again.
    rows = written(df.withColumn("rule", row_rule).withColumn("rule", repeated))
    left = rows.where(rule.isNull())
    # The rules left remove whole products, or rows by the product's own quantiles: one table says it all.
    per = left.groupBy(product).agg(
        F.sum(qty).alias("_total"), F.percentile(qty, 0.25).alias("_q1"), F.percentile(qty, 0.75).alias("_q3")
    )
    seen = coverage_by_product(left, product, date, first, last, scope).select(product, F.col("coverage").alias("_cov"))
    later = F.when(F.coalesce(F.col("_total") == 0, yes), "demanda_total_cero")
    later = later.when(F.coalesce(F.col("_cov") < min_coverage, yes), f"cobertura_baja_{scope}")
    if iqr:
        span = 1.5 * (F.col("_q3") - F.col("_q1"))
        out = (span > 0) & ((q < F.col("_q1") - span) | (q > F.col("_q3") + span))
        later = later.when(F.coalesce(out, yes), "outliers_iqr")
    judged = rows.join(per.join(seen, product), product, "left")
    return judged.withColumn("rule", F.coalesce(rule, later)).select(*df.columns, "rule")


def problem_case_filter(df: DataFrame, **kw) -> DataFrame:
    return problem_case_rules(df, **kw).where(F.col("rule").isNull()).drop("rule")


def removed_rows_by_rule(df: DataFrame, **kw) -> DataFrame:
    """The rows that the cascade removes, each with its rule."""
    return problem_case_rules(df, **kw).where(F.col("rule").isNotNull())


def rules_applied_per_product(df: DataFrame, **kw) -> DataFrame:
    """Sorted, comma-joined rules per product that lost rows; a product has at most one entry per rule."""
    product = kw["product"]
    gone = removed_rows_by_rule(df, **kw).where(F.col(product).isNotNull())
    return gone.groupBy(product).agg(F.concat_ws(",", F.array_sort(F.collect_set("rule"))).alias("rules"))


def flag_rows_in_set(df: DataFrame, keys_df: DataFrame, keys: list[str], flag: str = "is_outlier") -> DataFrame:
    listed = keys_df.select(*keys).distinct().withColumn("_in", F.lit(1))
    joined = df.alias("l").join(listed.alias("r"), null_safe("l", "r", keys), "left")
    return joined.select("l.*", F.col("r._in").isNotNull().cast("int").alias(flag))


def is_flagged(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 1


def extract_outlier_rows(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    return df.where(is_flagged(flag))


def outlier_row_stats(df: DataFrame, product: str, flag: str = "is_outlier") -> DataFrame:
    hit = is_flagged(flag)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(hit.cast("long")).alias("flagged"),
        F.countDistinct(product).alias("products"),
        F.countDistinct(F.when(hit, F.col(product))).alias("flagged_products"),
    )


def prepare_modeling_dataset(
    df: DataFrame, rename: dict[str, str], casts: dict[str, str], keys: list[str], target: str, tie: list[Column], columns: list[str]
) -> DataFrame:
    """Rename, cast, keep one row per key and rows with a target, project the columns that exist."""
    out = df.withColumnsRenamed(rename)
    out = out.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in out.columns})
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*tie))
    out = out.where(F.col(target).isNotNull()).withColumn("_nth", nth).where("_nth = 1")
    return out.select(*[c for c in columns if c in out.columns])


def map_with_fallback(df: DataFrame, valid: DataFrame, mapping: DataFrame, col: str, source: str, target: str, out: str) -> DataFrame:
    """The value itself where it is valid, else its mapped value, else null."""
    v = valid.select(F.col(col).alias("_valid")).distinct()
    m = mapping.groupBy(F.col(source).alias("_from")).agg(F.min(target).alias("_to"))
    joined = df.join(v, F.col(col) == F.col("_valid"), "left").join(m, F.col(col) == F.col("_from"), "left")
    return joined.withColumn(out, F.coalesce("_valid", "_to")).drop("_valid", "_from", "_to")


def text_search_filter(df: DataFrame, text: str, cols: list[str], supplier: tuple[str, str] | None = None) -> DataFrame:
    hit = contains_any(text, cols)
    if supplier:
        hit = hit & (F.col(supplier[0]) == supplier[1])
    return df.where(hit)


def ledger_filter(
    df: DataFrame, id_part: str = "", suppliers: list[str] = (), movements: list[str] = (), first: str | None = None, last: str | None = None
) -> DataFrame:
    """Ledger rows that satisfy every given condition; an empty condition is no condition."""
    tests = [F.lit(True)]
    if id_part:
        tests.append(F.contains(F.col("product_id").cast("string"), F.lit(id_part)))
    if suppliers:
        tests.append(F.col("supplier").isin(*suppliers))
    if movements:
        tests.append(F.col("movement").isin(*movements))
    if first:
        tests.append(F.col("date") >= F.lit(first).cast("date"))
    if last:
        tests.append(F.col("date") <= F.lit(last).cast("date"))
    return df.where(reduce(lambda a, b: a & b, tests))


def low_stock_flag(stock: str, limit: float = 20) -> Column:
    return F.when(F.col(stock) < limit, "Low").otherwise("OK")


def window_overrides(windows: DataFrame, patch: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """Replace the given columns of windows whose id the patch table names; null leaves a value as it is."""
    p = patch.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = windows.join(p, F.col(key) == F.col("_id"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*windows.columns)


def resolve_duplicates(df: DataFrame, keys: list[str], qty: str, strategy: str | list[str], order: list[str], others: list[str] = ()) -> DataFrame:
    """One row per key. ``order`` replaces "first": the other columns take their first non-null value in it.

    Several strategies are computed in one pass, each in a column ``<qty>_<strategy>``.
    """
    # The key columns of the order itself are spelled out so that equal rows give equal results.
    rank = F.struct(*[F.col(c) for c in order])
    how = {"mean": F.avg, "sum": F.sum, "max": F.max}
    many = [strategy] if isinstance(strategy, str) else strategy
    values = [
        (F.min_by(qty, F.when(F.col(qty).isNotNull(), rank)) if s == "first" else how[s](qty)).alias(qty if isinstance(strategy, str) else f"{qty}_{s}")
        for s in many
    ]
    rest = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in others]
    return df.groupBy(*keys).agg(*values, *rest)
