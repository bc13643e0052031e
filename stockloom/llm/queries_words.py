"""Queries of packing, spelling variants and periodic runs over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.llm.packing import packed, token_pieces
from stockloom.llm.registry import query, table
from stockloom.llm.runs import strongest, word_runs
from stockloom.llm.spelling import spelling_groups, word_counts


def _checksum_sql(numbers: str) -> str:
    """CRC-32 of a list of byte values in SQL; the table follows from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    step = f"xor(c >> 8, list_extract({table}, xor(c & 255, b) + 1)::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


def _bytes_sql(text: str) -> str:
    """UTF-8 bytes of a text without letters above U+00FF, as a list of numbers."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END))"


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, w, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY doc_id, w
), hashed AS (
    SELECT w, n, {_checksum_sql(_bytes_sql("coalesce(doc_id::VARCHAR, '') || ':' || w"))} AS h FROM runs
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
    SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
    UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), ranked AS (
    SELECT p.word, p.near, n.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY n.n DESC, encode(p.near)) AS rn
    FROM pairs p JOIN words n ON n.word = p.near
), formed AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rn = 1
), chain AS (
    SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""

RUNS_SQL = f"""
WITH split AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws, {_checksum_sql(_bytes_sql("doc_id::VARCHAR"))} AS h FROM documents
), placed AS (
    SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM split
), looped AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws
    FROM placed
), words AS (
    SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM looped
), grams AS (  -- a run repeats five words at the least
    SELECT doc_id, n, i, concat_ws(' ', w, lead(w) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), equal AS (
    SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n WHERE a.i + 5 <= a.n AND b.i + 5 <= b.n
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal) GROUP BY doc_id, q, k
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        first({{'start': start, 'length': length, 'period': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS best FROM runs GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS rest FROM words
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = words.doc_id AND words.i >= r.start + r.period AND words.i < r.start + r.length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
    (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op11_packing")
def op11_packing(spark, sf_dir):
    """Every piece of a document with the sequence that holds it and its place there."""
    import public_tokenizers

    cut = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(digest)


@query("op12_spelling", SPELLING_SQL)
def op12_spelling(spark, sf_dir):
    """Every frequent word with the more frequent word that it varies, and where such forms end."""
    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), slip_every=97)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_word_runs", RUNS_SQL)
def op13_word_runs(spark, sf_dir):
    """Every document with its periodic runs of words and what is left when they are collapsed."""
    found = word_runs(table(spark, sf_dir, "documents"), loop_every=10).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
