"""Readers and writers: CSV, Parquet, alias resolution at the edge, partitioned exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.text import parse_localized_number


def read_csv_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    decimal_comma: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header and an explicit schema; a malformed value becomes null."""
    numeric = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    read_as = schema
    if decimal_comma:
        read_as = T.StructType(
            [T.StructField(f.name, T.StringType() if f.name in numeric else f.dataType) for f in schema.fields]
        )
    df = (
        spark.read.schema(read_as)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    if decimal_comma:
        df = df.withColumns({c: parse_localized_number(c) for c in numeric})
    return df


def read_parquet_source(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_any_source(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Choose the reader from the suffix."""
    bare = path.lower().rstrip("/")
    if bare.endswith((".parquet", ".pq")):
        return read_parquet_source(spark, path)
    if bare.endswith((".csv", ".csv.gz", ".txt")):
        if schema is None:
            raise ValueError("a CSV source needs a schema")
        return read_csv_source(spark, path, schema, sep=sep)
    raise ValueError(f"no reader for {path}")


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[list[str], str]]) -> DataFrame:
    """``{canonical: ([candidates], type)}``: the first candidate present is renamed, else a null column.

    Names are compared without case; columns that no alias claims are kept.
    """
    by_lower: dict[str, str] = {}
    for c in df.columns:
        by_lower.setdefault(c.strip().lower(), c)
    picked: list = []
    used: set[str] = set()
    for name, (candidates, type_name) in aliases.items():
        found = next((by_lower[k.lower()] for k in [name, *candidates] if k.lower() in by_lower), None)
        if found is None:
            picked.append(F.lit(None).cast(type_name).alias(name))
        else:
            used.add(found)
            picked.append(F.col(f"`{found}`").alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases]
    return df.select(*picked, *rest)


def write_table_sink(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Overwrite ``path`` as Parquet or CSV, by suffix."""
    writer = df.write.mode("overwrite")
    if path.lower().endswith((".parquet", ".pq")):
        writer.parquet(path)
        return
    writer = writer.option("header", True)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def append_orders_sink(df: DataFrame, path: str, mode: str = "append") -> None:
    """Order lines (date, item_id, qty) with a positive quantity."""
    if mode not in ("append", "overwrite"):
        raise ValueError(mode)
    df.where(F.col("qty") > 0).select("date", "item_id", "qty").write.mode(mode).parquet(path)


def split_catalogue(
    df: DataFrame, cluster: str, split: str, date: str, splits: tuple[str, ...] = ("train", "val", "test")
) -> DataFrame:
    """Rows and date range of each (cluster, split), splits without rows included."""
    seen = df.groupBy(cluster, split).agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("date_min"), F.max(date).alias("date_max")
    )
    every = df.select(cluster).distinct().withColumn(split, F.explode(F.array(*[F.lit(s) for s in splits])))
    return every.join(seen, [cluster, split], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def export_partitioned_splits(df: DataFrame, path: str, cluster: str, split: str, date: str) -> DataFrame:
    """Write one folder per (cluster, split) and return the catalogue of what was written.

    Rows are shuffled by (cluster, split, month) before the write: a big split is written by as many
    tasks as it has months, and no task opens every folder.
    """
    spread = df.withColumn("_month", F.trunc(date, "MM")).repartition(cluster, split, "_month").drop("_month")
    spread.write.mode("overwrite").partitionBy(cluster, split).parquet(path)
    return split_catalogue(df, cluster, split, date)
