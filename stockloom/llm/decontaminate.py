"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockloom.llm.arrays import LOWER, flat, grams, pieces, prefix, spans, text_batches, words
from stockloom.llm.license_scan import IS_WORD

GRAM = 5
SIMILARITY = 0.8
STRIDE = 4
BLOCKS = 4  # of 16 bits
RADIUS = 15
KNOWN_BITS = 20
ITEMS_PER_PASS = 2000


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters, digits and non-ASCII bytes, A-Z lower-cased) and each text's first one."""
    raw, off = flat(column)
    data = LOWER[raw]
    starts, ends, first = words(data, off, IS_WORD)
    return spans(prefix(data), starts, ends), first


def window_bits(shingles: np.ndarray, sizes: list[int], stride: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per size, the 64-bit SimHash of every window of so many shingles that starts at a multiple of ``stride``.

    A bit is set where more than half of the window's shingles have it, repeats counted. Running sums of
    the bits make every window a difference of two rows, whatever its size. Sizes are multiples of ``stride``.
    """
    steps = len(shingles) // stride
    kind = np.uint8 if max(sizes) < 256 else np.uint16 if max(sizes) < 65536 else np.uint32
    bits = np.unpackbits(shingles[: steps * stride].view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((steps + 1, 64), kind)
    grouped = bits.reshape(steps, stride, 64).sum(1, dtype=kind) if stride > 1 else bits
    np.cumsum(grouped, axis=0, dtype=kind, out=sums[1:])
    for size in sizes:
        wide = size // stride
        if steps >= wide:
            yield size, np.packbits(sums[wide:] - sums[:-wide] > size // 2, axis=1).view(np.uint64).reshape(-1)


def window_size(n_shingles: int) -> tuple[int, int]:
    """``(size, stride)`` of the windows for an item: as large as it can be and still start in step.

    The item's own windows of this size begin at every offset, so one of at least ``STRIDE`` neighbouring
    ones lines up with the strided windows of a document that holds the item. Sizes grow by about a fifth.
    Items too short for that get windows of exactly their size at every word.
    """
    if n_shingles < 2 * STRIDE - 1:
        return n_shingles, 1
    size = STRIDE
    while (more := max(size + STRIDE, int(size * 1.2) // STRIDE * STRIDE)) <= n_shingles - (STRIDE - 1):
        size = more
    return size, STRIDE


@dataclass
class Sized:
    """The item windows of one size, and for each 16-bit block the windows within reach of each value."""

    size: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    heads: list[np.ndarray] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)

    def build(self, radius: int) -> Sized:
        """If two prints differ in at most ``radius`` bits, one block differs in at most radius // BLOCKS."""
        flips = radius // BLOCKS
        masks = np.array([sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(16), n)], np.uint64)
        for b in range(BLOCKS):
            block = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            value = (block[:, None] ^ masks[None, :]).astype(np.int64).reshape(-1)
            order = np.argsort(value, kind="stable")
            self.near.append((order // len(masks)).astype(np.int32))
            self.heads.append(np.searchsorted(value[order], np.arange(65537)).astype(np.int32))
        return self

    def search(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (position in ``prints``, entry) within the radius."""
        at, entry = [], []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            low = self.heads[b][value]
            count = self.heads[b][value + 1] - low
            hit = np.flatnonzero(count)
            count = count[hit]
            rows = np.repeat(hit, count)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            found = self.near[b][np.repeat(low[hit], count) + within]
            close = np.bitwise_count(prints[rows] ^ self.prints[found]) <= radius
            at.append(rows[close])
            entry.append(found[close])
        return np.concatenate(at), np.concatenate(entry)


@dataclass
class Index:
    """Benchmark items: their words, their shingles with counts, and their windows by size."""

    ids: list
    n_words: list[int]
    shingles: list[tuple[np.ndarray, np.ndarray]]
    sized: list[Sized]
    gram: int
    radius: int
    similarity: float
    known: np.ndarray | None = None

    def candidates(self, stream: np.ndarray, owner: np.ndarray, sized: Sized) -> np.ndarray:
        """The steps of the strided windows inside one text that can belong to a leak.

        Of an item's N shingles a leak of similarity s has at most N(1-s)/(1+s) that the item lacks, and its
        window ends at most ``STRIDE`` shingles outside. Windows with more shingles that no item has are left out;
        ``known`` can take a shingle for one of an item, never the other way round.
        """
        size, stride = sized.size, sized.stride
        start = np.arange(0, len(stream) // stride * stride - size + 1, stride)
        most = max(int(self.shingles[i][1].sum()) for i in np.unique(sized.item).tolist())
        unknown = np.concatenate([[0], np.cumsum(~self.known[stream >> np.uint64(64 - KNOWN_BITS)])])
        few = unknown[start + size] - unknown[start] <= int(most * (1 - self.similarity) / (1 + self.similarity) + 1e-9) + STRIDE
        start = start[few]
        return start[owner[start] == owner[start + size + self.gram - 2]] // stride

    def leaks(self, column: pa.Array) -> list[tuple[int, int, int, float]]:
        """``(text, item, first word, similarity)``: per text and item the best window that is similar enough."""
        hashes, first = word_hashes(column)
        if len(hashes) < self.gram:
            return []
        stream = grams(hashes, self.gram)  # over text borders too; windows across them are left out below
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        seen: set[tuple[int, int, int]] = set()
        for stride in sorted({s.stride for s in self.sized}):
            steps = {s.size: self.candidates(stream, owner, s) for s in self.sized if s.stride == stride}
            by_size = {s.size: s for s in self.sized if s.stride == stride and len(steps[s.size])}
            if not by_size:
                continue
            # only the steps that a candidate covers are summed
            cover = np.zeros(len(stream) // stride + 1, np.int64)
            for size in by_size:
                np.add.at(cover, steps[size], 1)
                np.add.at(cover, steps[size] + size // stride, -1)
            needed = np.cumsum(cover)[:-1] > 0
            place = np.cumsum(needed) - 1
            part = stream[: len(needed) * stride].reshape(-1, stride)[needed].reshape(-1)
            for size, prints in window_bits(part, sorted(by_size), stride):
                sized = by_size[size]
                at, entry = sized.search(prints[place[steps[size]]], self.radius)
                at = steps[size][at] * stride
                item, begin = sized.item[entry], at - sized.offset[entry]
                seen.update(zip(owner[at].tolist(), item.tolist(), begin.tolist()))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for text, item, begin in sorted(seen):
            if (got := best.get((text, item))) and got[0] == 1.0:
                continue
            for shift in sorted(range(-STRIDE, STRIDE + 1), key=abs):
                lo = max(begin + shift, int(first[text]))
                hi = min(begin + shift + self.n_words[item], int(first[text + 1]))
                score = self.compare(item, stream[lo : hi - self.gram + 1])
                old = best.get((text, item), (0.0, 0))
                if score > old[0]:
                    best[text, item] = (score, lo - int(first[text]))
                if score == 1.0:
                    break
        return [(text, item, begin, score) for (text, item), (score, begin) in sorted(best.items()) if score >= self.similarity]

    def compare(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity: a shingle weighs as often as it occurs."""
        values, counts = self.shingles[item]
        own, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        same = values[at] == own
        low = np.minimum(counts[at[same]], n[same]).sum()
        return float(low / (counts.sum() + n.sum() - low))


def build_index(ids: list, texts: list[str], gram: int = GRAM, radius: int = RADIUS, similarity: float = SIMILARITY) -> Index:
    out = Index([], [], [], [], gram, radius, similarity)
    groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item_id, text in zip(ids, texts):
        hashes, _ = word_hashes(pa.array([text], pa.string()))
        shingles = grams(hashes, gram)
        if not len(shingles):
            continue
        item = len(out.ids)
        out.ids.append(item_id)
        out.n_words.append(len(hashes))
        out.shingles.append(np.unique(shingles, return_counts=True))
        size, stride = window_size(len(shingles))
        for offset in range(len(shingles) - size + 1):
            (_, prints), *_ = window_bits(shingles[offset : offset + size], [size], stride)
            groups.setdefault((size, stride), []).append((int(prints[0]), item, offset))
    for (size, stride), rows in sorted(groups.items()):
        prints, item, offset = zip(*rows)
        out.sized.append(Sized(size, stride, np.array(prints, np.uint64), np.array(item), np.array(offset)).build(radius))
    out.known = np.zeros(1 << KNOWN_BITS, bool)
    for values, _ in out.shingles:
        out.known[values >> np.uint64(64 - KNOWN_BITS)] = True
    return out


def indexes(benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS, **how) -> Iterator[Index]:
    """Indexes of at most ``per_pass`` items each, so what is sent to the tasks of a pass is bounded."""
    ids, texts = [], []
    for row in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        if len(ids) == per_pass:
            yield build_index(ids, texts, **how)
            ids, texts = [], []
    yield build_index(ids, texts, **how)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: one row per document and item it holds.

    Every window of every document that has about the size of an item gets a SimHash of its 5-word
    shingles. Four 16-bit blocks are looked up with up to three bits flipped, which finds every item window
    within 15 bits; windows with too many shingles that no item has
    are left out before, as they cannot reach 0.8. Then the item is compared with the words at that place (weighted Jaccard of the
    shingles, at shifts of up to four words), and 0.8 is a leak. The documents are not shuffled: each pass
    sends an index of at most ``ITEMS_PER_PASS`` items to the tasks.

    Clean documents have no row. Nulls and texts of fewer than five words hold no leaks; items of fewer
    than five words have no shingle and are not looked for; rows without id are reported with a null id.
    Repeated rows and items are reported each. Of several places of one item the most similar, then the
    first is reported. Empty tables give no rows; further columns are ignored.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]

    def searched(index: Index) -> DataFrame:
        def run(batches):
            for piece in pieces(batches):
                hits = index.leaks(piece.column("text"))
                if hits:
                    text, item, start, score = zip(*hits)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": piece.column("doc_id").take(pa.array(text)),
                            "item_id": [index.ids[i] for i in item],
                            "start_word": pa.array(start, pa.int64()),
                            "n_words": pa.array([index.n_words[i] for i in item], pa.int64()),
                            "similarity": pa.array(score, pa.float64()),
                        }
                    )

        return text_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, start_word long, n_words long, similarity double")

    return reduce(DataFrame.unionByName, [searched(i) for i in indexes(benchmark, **how)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""

    def cleaned(rows: DataFrame, index: Index) -> DataFrame:
        def run(batches):
            for piece in pieces(batches):
                keep = np.ones(piece.num_rows, bool)
                keep[[hit[0] for hit in index.leaks(piece.column("text"))]] = False
                yield piece.filter(pa.array(keep))

        return text_batches(rows).mapInArrow(run, rows.schema)

    return reduce(cleaned, indexes(benchmark, **how), docs)
