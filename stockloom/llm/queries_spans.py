"""Queries that remove repeated passages from the whole of ``documents``."""

from __future__ import annotations

from stockloom.llm.chunk_dedup import without_repeated_chunks
from stockloom.llm.registry import query, table
from stockloom.llm.suffix_dedup import without_repeats

SPAN_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@query("op2_chunk_dedup")
def op2_chunk_dedup(spark, sf_dir):
    """Every document with what is left of it after repeated chunks are removed."""
    return without_repeated_chunks(table(spark, sf_dir, "documents")).select(*SPAN_COLUMNS)


CUT_SQL = """
WITH raw AS (
    SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (  -- hexadecimal digits, two a byte
    SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM raw WHERE length(h) >= 200)
), late AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM strings) WHERE rn > 1
), marked AS (
    SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM late
), grouped AS (
    SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM grouped GROUP BY doc_id, span
), gaps AS (  -- what stands before each span, and behind the last
    SELECT s.doc_id, coalesce(lag(s.b) OVER d, 0) AS a, s.a AS b FROM spans s WINDOW d AS (PARTITION BY s.doc_id ORDER BY s.a)
    UNION ALL SELECT r.doc_id, coalesce(m.b, 0), length(r.h) // 2 FROM raw r LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) m ON m.doc_id = r.doc_id
), rest AS (
    SELECT g.doc_id, string_agg(substring(r.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN raw r ON r.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT r.doc_id, length(r.h) // 2 AS n_bytes, coalesce(x.n_removed, 0)::BIGINT AS n_removed, coalesce(x.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM raw r JOIN rest k ON k.doc_id = r.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) x ON x.doc_id = r.doc_id
"""


@query("op9_suffix_dedup", CUT_SQL)
def op9_suffix_dedup(spark, sf_dir):
    """Every document with what is left of it after bytes of earlier 100-byte strings are removed."""
    return without_repeats(table(spark, sf_dir, "documents")).select(*SPAN_COLUMNS)
