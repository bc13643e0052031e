"""Running totals, positions and exact quantiles that never put one whole group into one task.

A window partitioned by a key alone sends all rows of that key to one task. The helpers here cut
each group into consecutive pieces, total the pieces, carry the totals over (one row per piece) and
add the carried offset to the total inside the piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import written


def null_safe(left: str, right: str, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list, value: str | Column, out: str
) -> DataFrame:
    """Inclusive running total of ``value`` per ``keys``; ``bucket`` must not contradict ``order``.

    ``bucket`` is a coarser form of the order (a day or month): a hot key is spread over as many
    tasks as it has buckets. Nothing is materialised.
    """
    v = F.col(value) if isinstance(value, str) else value
    work = df.withColumn("_v", v)
    pieces = work.groupBy(*keys, bucket).agg(F.sum("_v").alias("_piece"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*keys, bucket, F.coalesce(F.sum("_piece").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = work.withColumn("_local", F.sum("_v").over(inside))
    joined = local.alias("l").join(offsets.alias("o"), null_safe("l", "o", [*keys, bucket]))
    kept = [F.col(f"l.{c}") for c in df.columns if c != out]
    return joined.select(*kept, (F.col("l._local") + F.col("o._before")).alias(out))


def range_running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Inclusive running total where the order has no natural bucket.

    Rows are range-partitioned by (keys, order), so a hot key covers many partitions. The partition
    number is used twice, therefore the partitioned rows are written as a table before it is read.
    """
    spread = df.repartitionByRange(*keys, *order) if (keys or order) else df
    placed = written(spread.withColumn("_piece_no", F.spark_partition_id()).withColumn("_v", value))
    keyed = placed if keys else placed.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    pieces = keyed.groupBy(*group, "_piece_no").agg(F.sum("_v").alias("_piece"))
    before = Window.partitionBy(*group).orderBy("_piece_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*group, "_piece_no", F.coalesce(F.sum("_piece").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_piece_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("_local", F.sum("_v").over(inside))
    joined = local.alias("l").join(offsets.alias("o"), null_safe("l", "o", [*group, "_piece_no"]))
    kept = [F.col(f"l.{c}") for c in df.columns if c != out]
    return joined.select(*kept, (F.col("l._local") + F.col("o._before")).alias(out))


def row_positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """1-based position of each row in its group, for groups of any size. ``order`` must be total."""
    return range_running_total(df, keys, order, F.lit(1).cast("long"), out)


def value_counts_cumulated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (keys, value): ``n`` rows with that value and ``cum`` rows with a value not above it.

    Equal values are merged before any ordering, so ties cost nothing.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return range_running_total(counts, keys, [F.col(value).asc()], F.col("n"), "cum")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Per (keys, value): number of ties ``n`` and the average rank, as rank statistics need."""
    counted = value_counts_cumulated(df, keys, value)
    return counted.select(*keys, value, "n", (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2).alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups too big for one aggregation buffer."""
    counted = value_counts_cumulated(df, keys, value)
    group = keys or ["_all"]
    counted = counted if keys else counted.withColumn("_all", F.lit(0))
    totals = counted.groupBy(*group).agg(F.sum("n").alias("_total"))
    placed = counted.alias("c").join(totals.alias("t"), null_safe("c", "t", group)).select("c.*", "t._total")
    first, last = F.col("cum") - F.col("n"), F.col("cum") - 1
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (first <= at) & (at <= last)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*group, "_total").agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *cols)
