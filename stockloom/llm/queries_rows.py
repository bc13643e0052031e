"""Queries of exact dedup, mixing and sharding: each applies its operator to the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.llm import mixing
from stockloom.llm.exact_dedup import exact_groups
from stockloom.llm.registry import query, table
from stockloom.llm.sharding import sharded
from stockloom.llm.url_filter import judged_urls


def _position_sql() -> str:
    """``demanded_until`` in SQL, from the same schedules; ``share`` and ``kind`` are columns."""
    cases = []
    for n, schedule in enumerate(mixing.SCHEDULES):
        areas = mixing._areas(schedule)
        arms = []
        for i in range(len(mixing.KNOTS) - 1):
            w0, w1, d = schedule[i], schedule[i + 1], mixing.KNOTS[i + 1] - mixing.KNOTS[i]
            rest = f"greatest(share * {areas[-1]}::DOUBLE - {areas[i]}::DOUBLE, 0::DOUBLE)"
            root = f"sqrt(greatest({w0 * w0}::DOUBLE + 2::DOUBLE * {rest} * {(w1 - w0) / d}::DOUBLE, 0::DOUBLE))"
            inside = f"least({mixing.KNOTS[i]}::DOUBLE + coalesce(2::DOUBLE * {rest} / nullif({w0}::DOUBLE + {root}, 0), 0::DOUBLE), {mixing.KNOTS[i + 1]}::DOUBLE)"
            arms.append(f"WHEN share * {areas[-1]}::DOUBLE <= {areas[i + 1]}::DOUBLE THEN {inside}")
        cases.append(f"WHEN {n} THEN CASE {' '.join(arms)} ELSE 1::DOUBLE END")
    return f"CASE kind {' '.join(cases)} END"


MIX_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), kinds AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM sources
), weighed AS (
    SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM kinds
), cut AS (
    SELECT a.*, (SELECT sum(source_size) FROM sources) AS total,
        (SELECT sum(CASE WHEN 3 * b.source_size * a.weight <= 3 * a.source_size * b.weight THEN 3 * b.source_size ELSE 0 END) FROM weighed b) AS stopped,
        (SELECT sum(CASE WHEN 3 * b.source_size * a.weight <= 3 * a.source_size * b.weight THEN 0 ELSE b.weight END) FROM weighed b) AS left_weight
    FROM weighed a
), stops AS (  -- a source stops if all would take more than there is at its own stop level
    SELECT *, stopped::DOUBLE + 3::DOUBLE * source_size / weight * left_weight < total AS stop FROM cut
), level AS (
    SELECT (any_value(total) - sum(CASE WHEN stop THEN 3 * source_size ELSE 0 END))::DOUBLE AS num,
        sum(CASE WHEN stop THEN 0 ELSE weight END)::DOUBLE AS den FROM stops
), targets AS (
    SELECT source, kind, source_size, coalesce(CASE WHEN stop THEN (3 * source_size)::DOUBLE ELSE weight * num / nullif(den, 0) END, 0::DOUBLE) AS target
    FROM stops, level
), streams AS (
    SELECT d.doc_id, d.size, t.kind, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS LAST, d.size
            ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), reads AS (
    SELECT *, greatest(0, least(size, words - epoch * source_size - start))::BIGINT AS n_read
    FROM streams, (SELECT unnest([0, 1, 2, 3]) AS epoch)
), placed AS (
    SELECT *, least(coalesce((epoch * source_size + start + n_read::DOUBLE / 2) / nullif(words, 0)::DOUBLE, 0::DOUBLE), 1::DOUBLE) AS share FROM reads
)
SELECT doc_id, size, source_size, target, sum(n_read)::BIGINT AS taken,
    (count(*) FILTER (WHERE n_read > 0))::INTEGER AS n_epochs,
    floor(min(CASE WHEN n_read > 0 THEN {_position_sql()} END) * 1e9 + 0.5) / 1e9 AS first_position
FROM placed GROUP BY doc_id, size, source_size, target, start
"""

EXACT_SQL = """
WITH base AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), placed AS (
    SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM base
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM placed
"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark, sf_dir):
    """Words that the curriculum takes from every document, and where it first stands in training."""
    mixed = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    first = F.array_min(F.transform("placements", lambda p: p["position"]))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("placements").alias("n_epochs"), (F.floor(first * 1e9 + 0.5) / 1e9).alias("first_position")
    )


@query("op5_exact_dedup", EXACT_SQL)
def op5_exact_dedup(spark, sf_dir):
    """Every document with the row that stays of its group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    """Every document with its shard under a rebalanced map of virtual slots, and its place there."""
    return sharded(table(spark, sf_dir, "documents"))


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    """Every page with its host, path, rule and verdict."""
    return judged_urls(table(spark, sf_dir, "pages"))
