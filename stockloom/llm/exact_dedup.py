"""Exact duplicates: 128-bit content hashes, with a comparison of the bytes inside each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.session import written

# The characters that do not count, [\x20\x09-\x0D].
IGNORED = (" ", "\t", "\n", "\x0b", "\f", "\r")


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), IGNORED, F.coalesce(text, F.lit("")))


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, digest=content_hash, normalise=squeezed) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Documents are grouped by ``digest`` of the normalised text. A group carries the least and the
    greatest text it met: where they are equal, so are all its bytes. Groups where they differ are
    grouped again by the text itself, so a collision never merges texts. Of equal texts the one with
    the most code points in the original stays, then the smallest ``doc_id``. Both groupings sum up
    before the shuffle; the groups are written before the rows are joined back to them, and then Spark
    can split the rows of one very large group.

    Nulls: a null text is an empty one; empty texts are equal to each other. A row without ``doc_id``
    is counted, but stays only if no row of its group has an id (``keep_id`` is then null). Rows that
    repeat a ``doc_id`` and a text get the same result. An empty table gives no rows. Further columns
    are ignored.
    """
    text = normalise(F.col("text"))
    base = docs.select(
        F.col("doc_id").alias("doc_id"), text.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("points")
    ).withColumn("h", digest(F.col("norm")))
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("neg"))).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    groups = written(
        base.groupBy("h")
        .agg(size, best, (F.min("norm") != F.max("norm")).alias("collided"))
        .select("h", "group_size", (-F.col("best.neg")).alias("keep_id"), "collided")
    )
    collided = groups.where("collided").select("h")
    apart = written(
        base.join(collided, "h", "left_semi")
        .groupBy("h", "norm")
        .agg(size, best)
        .select("h", F.sha2("norm", 256).alias("sha"), "group_size", (-F.col("best.neg")).alias("keep_id"))
    )
    rows = base.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    joined = rows.join(groups, "h").alias("g").join(
        apart.alias("a"), (F.col("g.h") == F.col("a.h")) & (F.col("g.text_sha256") == F.col("a.sha")) & F.col("g.collided"), "left"
    )
    pick = lambda c: F.when(F.col("g.collided"), F.col(f"a.{c}")).otherwise(F.col(f"g.{c}"))
    return joined.select(
        F.col("g.doc_id").alias("doc_id"),
        pick("keep_id").alias("keep_id"),
        pick("group_size").alias("group_size"),
        F.col("g.doc_id").eqNullSafe(pick("keep_id")).alias("kept"),
        F.col("g.text_sha256").alias("text_sha256"),
    )
