"""Queries of near duplicates and quality over the whole of ``documents``."""

from __future__ import annotations

from stockloom.llm.decontaminate import find_leaks
from stockloom.llm.license_scan import scan_licenses
from stockloom.llm.minhash import near_duplicates
from stockloom.llm.quality import fit_quality, score_documents
from stockloom.llm.registry import query, table


NEAR_SQL = """
WITH worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingles FROM worded
), flat AS MATERIALIZED (
    SELECT doc_id, len(shingles) AS n, hash(s) AS s FROM (SELECT doc_id, shingles, unnest(shingles) AS s FROM sets)
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), component AS (
    WITH RECURSIVE lab(doc_id, label) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM documents
        UNION SELECT e.a, min(l.label) FROM links e JOIN lab l ON l.doc_id = e.b JOIN recurring.lab r ON r.doc_id = e.a WHERE l.label < r.label GROUP BY e.a)
    SELECT doc_id, label FROM lab
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.label AS component_id, s.doc_id = c.label AS kept FROM sets s JOIN component c ON c.doc_id = s.doc_id
"""


@query("op3_minhash", NEAR_SQL)
def op3_minhash(spark, sf_dir):
    """Every document with its near-duplicate component over two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    """Every document with the score of trees fitted on the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    """Every document with its license phrases and notices."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op1_decontaminate")
def op1_decontaminate(spark, sf_dir):
    """Every pair of a document and a benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
