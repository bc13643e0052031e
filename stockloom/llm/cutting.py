"""Cuts byte spans out of texts. Texts without spans are not shuffled."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import pieces, text_batches
from stockloom.llm.keyfilter import found, key_filter

LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``ord, text_key, text``: the id as an order (no id: last) and a hash that tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return text_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def row_key() -> Column:
    return F.xxhash64("ord", "text_key")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per document, without its spans.

    ``spans(ord, text_key, start, end)`` are byte ranges that may overlap; runs shorter than ``least``
    stay. ``kept`` holds the remaining bytes, null where nothing was removed. A bit array of fixed size
    tells the scan which texts have spans; only these go through the join.
    """
    per_text = spans.groupBy("ord", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    wanted = key_filter(spans.select(row_key().alias("key")).distinct(), "key")

    def scan(batches):
        for piece in pieces(batches):
            texts = piece.column("text")
            maybe = found(wanted, piece.column("key").to_numpy())
            # whole texts are hashed here, those to be cut behind the join
            sha = [None if m else hashlib.sha256(t.as_buffer()).hexdigest() if t.as_buffer() is not None else hashlib.sha256(b"").hexdigest() for m, t in zip(maybe, texts)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("ord"), piece.column("text_key"), piece.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(sha, pa.string()), texts.take(pa.array(np.arange(len(maybe)), mask=~maybe))],
                names=["ord", "text_key", "doc_id", "n_bytes", "sha", "text"],
            )

    def trim(batches):
        for batch in batches:
            rows = []
            for text, spans, sha in zip(batch.column("text"), batch.column("spans"), batch.column("sha")):
                runs = []
                if text.is_valid and spans.is_valid:
                    flat = spans.values
                    runs = [r for r in merged(flat.field("start").to_pylist(), flat.field("end").to_pylist()) if r[1] - r[0] >= least]
                if not runs:
                    rows.append((0, 0, sha.as_py() or hashlib.sha256(text.as_buffer() or b"").hexdigest(), None))
                    continue
                raw, at, kept = text.as_buffer().to_pybytes(), 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                rows.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest))
            removed, n, sha, kept = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    source = keyed(docs.select("doc_id", "text")).withColumn("key", row_key()).withColumn("doc_id", F.when(F.col("ord") != LAST, F.col("ord")))
    scanned = source.mapInArrow(scan, "ord long, text_key long, doc_id long, n_bytes long, sha string, text string")
    joined = scanned.join(per_text, ["ord", "text_key"], "left").select("doc_id", "n_bytes", "sha", "text", "spans")
    return joined.mapInArrow(trim, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
