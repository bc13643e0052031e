"""Unions, differences and duplicate checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.text import normalize_product_id
from stockloom.operators.aggregates import count_if, one
from stockloom.session import written


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_years(frames: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.withColumn("source", F.lit(tag)) for tag, df in frames.items()])


# The columns of the unified substitute table.
SUBSTITUTE_COLUMNS = {
    "product_id": "bigint", "kind": "string", "substitute_id": "bigint", "supplier_id": "bigint", "score": "double",
    "price": "double", "availability": "double", "lead_time": "int", "priority": "int",
}


def union_substitutes(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Internal alternatives (other suppliers) and external ones (other products), without self-pairs."""
    a = internal.withColumn("kind", F.lit("interno"))
    b = external.where(F.col("product_id") != F.col("substitute_id")).withColumn("kind", F.lit("externo"))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SUBSTITUTE_COLUMNS.items()
        ])

    return shaped(a).unionByName(shaped(b)).distinct()


def union_distinct_days(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def category_set_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values of one side only, with the side."""
    left, right = a.select(col).distinct(), b.select(col).distinct()
    return left.join(right, col, "left_anti").withColumn("only_in", F.lit("a")).unionByName(
        right.join(left, col, "left_anti").withColumn("only_in", F.lit("b"))
    )


def asymmetric_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose reverse is missing; ids are brought to one form first."""
    p = pairs.select(normalize_product_id(a).alias(a), normalize_product_id(b).alias(b)).na.drop().distinct()
    return p.join(p.select(F.col(a).alias(b), F.col(b).alias(a)), [a, b], "left_anti")


def exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated rows with their number, and the table without repeats."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1"), counted.drop("n")


def subset_containment(subset: DataFrame, full: DataFrame, product: str) -> DataFrame:
    """Ids of the subset that the full set lacks; no rows means contained."""
    return subset.select(product).distinct().join(full.select(product).distinct(), product, "left_anti")


def ledger_union_dedup(history: DataFrame, live: DataFrame) -> DataFrame:
    """Past sales and live ledger, one row per (product, day, movement, quantity)."""
    both = history.unionByName(live)
    ok = (F.col("qty") > 0) & F.col("product_id").cast("string").rlike(r"^\d+$")
    return both.where(ok).select("product_id", F.to_date("date").alias("date"), "movement", "qty").distinct()


def unusual_substitutes(subs: DataFrame, min_score: float = 0.70) -> DataFrame:
    low = subs.where((F.col("kind") == "externo") & (F.col("score") < min_score))
    bad = (F.col("price") <= 0) | (F.col("lead_time") < 0) | (F.col("availability") < 0) | F.col("priority").isNull()
    odd = subs.where((F.col("kind") == "interno") & F.coalesce(bad, F.lit(False)))
    # Texts of the reasons.
    return low.withColumn("reason", F.lit(f"externo_score<{min_score}")).unionByName(
        odd.withColumn("reason", F.lit("interno_metricas_incoherentes"))
    )


def union_order_sources(frames: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Order lines of several sources as (date, product_id, qty); a quantity that is no number counts 0."""
    parts = []
    for df, cols in frames:
        qty = F.coalesce(F.col(cols["qty"]).cast("string").try_cast("double"), F.lit(0.0))
        parts.append(df.select(F.col(cols["date"]).alias("date"), F.col(cols["product_id"]).alias("product_id"), qty.alias("qty")))
    return union_all(parts)


def history_plus_forecast(history: DataFrame, forecast: DataFrame, first: str, year: int) -> DataFrame:
    past = history.where(F.col("date") >= F.lit(first).cast("date")).select("product_id", "date", "qty", F.lit("history").alias("part"))
    future = forecast.where(F.year("date") == year).select("product_id", "date", F.col("y_pred").alias("qty"), F.lit("forecast").alias("part"))
    return past.unionByName(future)


def quality_snapshot(subs: DataFrame) -> DataFrame:
    """Counts of the unified substitute table as one JSON row."""
    subs = written(subs)
    pairs = subs.where("kind = 'externo'").select("product_id", "substitute_id")
    asym = asymmetric_pairs(pairs, "product_id", "substitute_id").agg(F.count(F.lit(1)))
    odd = unusual_substitutes(subs).agg(F.count(F.lit(1)))
    dup = exact_duplicates(subs)[0].agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long"))
    row = subs.agg(
        one().alias("n_rows"), F.countDistinct("product_id").alias("n_products"),
        count_if(F.col("kind") == "interno").alias("n_internal"), count_if(F.col("kind") == "externo").alias("n_external"),
    ).select("*", dup.scalar().alias("n_duplicates"), asym.scalar().alias("n_asymmetric"), odd.scalar().alias("n_unusual"))
    return row.select(F.to_json(F.struct("*")).alias("snapshot"))
