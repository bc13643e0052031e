"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import IS_SPACE, LOWER, flat, grams, pieces, prefix, spans, text_batches, within, words

# At most so many labelled rows are fitted on, picked by a hash of the id.
MOST_LABELS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes log_words mean_word sd_word log_longest_word upper digits punctuation other_symbols non_ascii space lines_per_word "
    "repeated_bytes distinct_words top_word distinct_pairs distinct_triples distinct_lines words_ending_odd "
    "symbol_words short_words words_per_stop capital_words"
).split()


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _lut(bytes(range(65, 91)))
_DIGIT = _lut(bytes(range(48, 58)))
_STOP = _lut(b".?!")
_COMMON = _lut(b".,;:'\"()-?!")
_PUNCT = _lut(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_ODD = _PUNCT & ~_lut(b".,;:?'\")")
_LETTER = _lut(bytes(c for c in range(256) if chr(c).isalpha() and c < 128)) | _lut(bytes(range(128, 256)))


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch ``at[i]:at[i+1]``: the number of distinct values and the count of the commonest."""
    n = len(at) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        own = np.sort(hashes[at[i] : at[i + 1]])
        if len(own):
            cuts = np.flatnonzero(own[1:] != own[:-1])
            distinct[i] = len(cuts) + 1
            top[i] = np.diff(np.concatenate(([-1], cuts, [len(own) - 1]))).max()
    return distinct, top


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text. A null or empty text has zeros everywhere."""
    data, off = flat(column)
    n_bytes = np.diff(off).astype(float)
    starts, ends, first = words(data, off, ~IS_SPACE)
    n_words = np.diff(first).astype(float)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)

    def total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    length = (ends - starts).astype(float)
    mean = total(length, first) / per_word
    spread = np.sqrt(np.maximum(total(length * length, first) / per_word - mean * mean, 0))
    longest = np.zeros(len(off) - 1)
    full = n_words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, first[:-1][full])
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    hashes = spans(prefix(LOWER[data]), starts, ends)
    distinct, top = _distinct(hashes, first)
    shares = []
    for k in (2, 3):
        some = np.maximum(n_words - k + 1, 0)
        at = np.concatenate(([0], np.cumsum(some))).astype(np.int64)
        shares.append(_distinct(grams(hashes, k)[within(first, k)], at)[0] / np.maximum(some, 1))
    line = np.zeros(256, bool)
    line[10] = True
    l_starts, l_ends, l_first = words(data, off, ~line)
    n_lines = np.maximum(np.diff(l_first), 1)
    lines = _distinct(spans(prefix(data), l_starts, l_ends), l_first)[0] / n_lines
    letters = np.zeros(len(data) + 1)
    np.cumsum(_LETTER[data], out=letters[1:])
    return np.column_stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), mean, spread, np.log1p(longest),
            total(_UPPER[data], off) / per_byte, total(_DIGIT[data], off) / per_byte,
            total(_PUNCT[data] & _COMMON[data], off) / per_byte, total(_PUNCT[data] & ~_COMMON[data], off) / per_byte,
            total(data > 127, off) / per_byte, total(IS_SPACE[data], off) / per_byte, np.diff(l_first) / per_word,
            total(same, off) / per_byte, distinct / per_word, top / per_word, shares[0], shares[1], lines,
            total(_ODD[data[ends - 1]] if len(ends) else np.zeros(0), first) / per_word,
            total(letters[ends] == letters[starts], first) / per_word, total(length <= 3, first) / per_word,
            n_words / (1 + total(_STOP[data], off)), total(_UPPER[data[starts]] if len(starts) else np.zeros(0), first) / per_word,
        ]
    )


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a value above goes right
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosts the logistic loss; splits are searched on histograms of the binned columns."""
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        return Trees(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            pick = np.full((width, 2), -1)
            for f, e in enumerate(edges):
                at = (node - low) * bins + binned[:, f]
                sums = [np.bincount(at, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = (tuple(s[:, :-1] for s in sums), tuple(s[:, -1:] for s in sums))
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(nl < least) | (na - nl < least)] = 0
                gain[:, len(e) :] = 0
                where = gain.argmax(1)
                top = gain[np.arange(width), where]
                better = top > best
                best[better] = top[better]
                pick[better] = np.column_stack([np.full(width, f), where])[better]
            for i in np.flatnonzero(pick[:, 0] >= 0):
                feature[t, low + i], cut[t, low + i] = pick[i, 0], edges[pick[i, 0]][pick[i, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += leaf[t][at]
    return Trees(feature, cut, leaf, base)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Trees:
    """Trees fitted on at most ``most`` labelled documents outside the held-out fifth.

    Of all labelled ids those with the smallest hashes are taken; their statistics, one row of numbers
    each, are what the driver sees. Null labels and ids are left out, several labels of one id count as
    the lowest. Without labels of both kinds the score is the share of label 1 (or 0.999 without any).
    """
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def run(batches):
        for piece in pieces(batches):
            x = text_statistics(piece.column("text"))
            flat_x = pa.array(x.reshape(-1))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.FixedSizeListArray.from_arrays(flat_x, x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    sample = text_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``most`` ids
    rows = sample.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id string, quality int, x array<double>")
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_trees(x, got["quality"].to_numpy(float))


def score_documents(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its text alone.

    Nulls: a null text is scored as an empty one; a row without id is held out. Repeated rows get equal
    scores. An empty table gives no rows. Further columns are ignored.
    """

    def run(batches):
        for piece in pieces(batches):
            score = model.score(text_statistics(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = text_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""

    def run(batches):
        for piece in pieces(batches):
            yield piece.filter(pa.array(model.score(text_statistics(piece.column("text"))) >= threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)
