"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of 0..2**32 make the whole signature: sigma places every shingle, pi orders the places,
and coordinate k is the least pi over the places shifted by k around the circle. Both are fixed mixing
bijections, so no table is kept and every run gives the same signatures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrays import FOLD, IS_SPACE, LOWER, flat, grams, lists, mixed, pieces, prefix, spans, text_batches, within, words
from stockloom.llm.columns import free_names
from stockloom.llm.keyfilter import found, id_key, key_filter
from stockloom.operators.components import components
from stockloom.session import written

# 32 bands of 4 rows: a pair at Jaccard 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes, flat, and how many each has.

    A-Z are lower-cased; a text with fewer than ``k`` words has its whole sequence as one shingle, a text
    without words has none.
    """
    raw, offsets = flat(column)
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, ~IS_SPACE)
    hashes = spans(prefix(data), starts, ends)
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    every = np.empty(at[-1], np.uint64)
    every[np.repeat(n >= k, counts)] = grams(hashes, k)[within(first, k)]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            every[at[short]] = grams(hashes, m)[first[short]]
    sets = [np.unique(every[at[i] : at[i + 1]]) for i in range(len(n))]
    return (np.concatenate(sets) if sets else every), np.array([len(s) for s in sets], np.int64)


def signatures(shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates per set; sets must not be empty."""
    place = (mixed(shingles ^ FOLD) >> np.uint64(32)).astype(np.uint32)  # sigma
    heads = np.cumsum(counts) - counts
    out = np.empty((size, len(counts)), np.uint32)
    order, half = np.empty_like(place), np.empty_like(place)
    for k in range(size):
        np.right_shift(place, np.uint32(16), out=half)  # pi of the shifted places
        np.bitwise_xor(place, half, out=order)
        np.multiply(order, np.uint32(0x85EBCA6B), out=order)
        np.right_shift(order, np.uint32(13), out=half)
        np.bitwise_xor(order, half, out=order)
        np.multiply(order, np.uint32(0xC2B2AE35), out=order)
        np.right_shift(order, np.uint32(16), out=half)
        np.bitwise_xor(order, half, out=order)
        np.minimum.reduceat(order, heads, out=out[k])
        np.add(place, np.uint32(1), out=place)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; the band is part of the key."""
    keys = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = h * FOLD + signature[b * rows + r]
        keys[:, b] = mixed(h)
    return keys


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, d1, d2, bands, code``: d1 and d2 are a 128-bit digest of the whole shingle set.

    ``code`` has the lowest byte of every coordinate of the signature.
    """

    def run(batches):
        for piece in pieces(batches):
            flat_set, counts = shingle_sets(piece.column("text"), k)
            full = counts > 0
            heads = (np.cumsum(counts) - counts)[full]
            digests = np.zeros((2, len(counts)), np.uint64)
            keys, code = np.zeros((0, bands), np.uint64), np.zeros((0, bands * rows), np.int8)
            if len(heads):
                digests[0, full] = np.add.reduceat(mixed(flat_set), heads)
                digests[1, full] = np.add.reduceat(mixed(flat_set * FOLD + np.uint64(1)), heads)
                signature = signatures(flat_set, counts[full], bands * rows)
                keys, code = band_keys(signature, bands, rows), signature.T.astype(np.uint8).view(np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), piece.column("text_key"), pa.array(counts), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                    lists(keys.reshape(-1).view(np.int64), full * bands), lists(code.reshape(-1), full * bands * rows),
                ],
                names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands", "code"],
            )

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>, code array<tinyint>"
    )


def text_key() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles`` of the documents in ``ids(doc_id)`` and of few others."""
    wanted = key_filter(ids.select(id_key("doc_id").alias("key")), "key")

    def run(batches):
        for batch in batches:
            keep = found(wanted, batch.column("key").to_numpy())
            for piece in pieces([batch.filter(pa.array(keep))]):
                flat_set, counts = shingle_sets(piece.column("text"), k)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists(flat_set.view(np.int64), counts)], names=["doc_id", "shingles"])

    source = text_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return source.withColumn("key", id_key("doc_id")).mapInArrow(run, schema).join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    near = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return near.where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose ``k``-word shingle sets have a Jaccard similarity of ``percent`` hundredths or more
    are linked, and ``component_id`` is the smallest ``doc_id`` reachable over links.

    Texts with equal shingle sets become one class before anything is paired. In a bucket of one band
    the classes are compared with one pivot, chosen anew by each band, so a bucket of n classes makes
    n - 1 pairs. Pairs inside one component cannot change the result; only where a bucket then still holds
    classes of different components is there more to verify, and every pair that shares a band and could
    join two components is: a class of the smaller component against all members of the larger one, in
    blocks of bounded size that return just the links (``_against_components``), and classes that have no
    link yet against each other, each pair in its first common bucket only, if enough coordinates of their
    signatures agree (fewer than the least number at 0.8 has a probability below 2e-6).

    Nulls and empty texts have no shingles and no links. A row without ``doc_id`` cannot be named: it has
    a null ``component_id``, links nothing and is kept. Rows that repeat a ``doc_id`` are one node with
    several texts: what one of them is linked to, all are. Ids must be whole numbers. An empty table gives
    no rows; further columns are ignored.
    """
    return _judged(docs, k, percent, bands, rows, by_id=True).drop("text_key")


def _judged(docs: DataFrame, k: int, percent: int, bands: int, rows: int, by_id: bool) -> DataFrame:
    """:func:`near_duplicates` with the ``text_key`` of every row. Without ``by_id`` an id links no texts that differ."""
    signed = written(_signed(docs, k, bands, rows))
    classes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    named = signed.join(classes, ["d1", "d2"], "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), "bands", "code")
    members = written(
        named.select(
            "doc_id",
            "text_key",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"),
            F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"),
            F.when(F.col("doc_id") == F.col("rep"), F.col("code")).alias("code"),
        )
    )
    known, links = _links(docs, members, k, percent, bands * rows)
    if by_id:
        ids = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi"))
        twice = written(ids.where("a < hi").select("doc_id", "a"))
        if not twice.isEmpty():
            links = links.unionByName(members.join(twice, "doc_id").select("a", F.col("rep").alias("b")).where("a < b"))
    found_ids = written(_followed(known, links))
    joined = members.join(found_ids, members["rep"] == found_ids["node"], "left")
    component = F.coalesce("component", "rep")
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _followed(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known(node, component)`` after more ``links(a, b)``, which are few: only they are followed, between whole components."""
    at = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = written(components(moved))
    wider = over.select(F.col("node").alias("component"), F.col("component").alias("_wider"))
    old = known.join(wider, "component", "left").select("node", F.coalesce("_wider", "component").alias("component"))
    return old.unionByName(over.join(known, "node", "left_anti"))


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """The components ``(node, component)`` of the links to pivots, and the links ``(a, b)`` found beside them."""
    reps = members.where(F.size("bands") > 0).select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    pivots = written(
        reps.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("p")).where("c > 1").select("key", "c", F.col("p").bitwiseXOR(F.col("key")).alias("pivot"))
    )
    buckets = written(reps.join(pivots, "key"))
    pairs = written(buckets.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    # Columns of long arrays are read in large ranges, which the vectored reader holds outside of the heap.
    sets = written(_sets(docs, ids, k), **{"parquet.hadoop.vectored.io.enabled": "false"})
    sure = written(_confirmed(pairs, sets, percent))
    known = written(components(sure))
    sized = written(known.groupBy("component").agg(F.count(F.lit(1)).alias("members")))
    named = written(known.join(sized, "component").select(F.col("node").alias("rep"), "component", "members"))
    placed = written(
        buckets.where("c > 2")
        .join(named, "rep", "left")
        .select("key", "band", "rep", "n", "pivot", F.coalesce("component", "rep").alias("component"), F.coalesce("members", F.lit(1)).alias("members"))
    )
    split = written(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    open_rows = written(placed.join(split, "key"))
    to_members = _against_components(open_rows, named, sets, percent)
    singles = _between_singles(open_rows, members, sets, percent, coordinates)
    return known, to_members.unionByName(singles)


def _between_singles(open_rows: DataFrame, members: DataFrame, sets: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Links between classes that have none yet and share a bucket."""
    share = percent / 100
    least = int(coordinates * share - 4.7 * (coordinates * share * (1 - share)) ** 0.5)
    signed = members.where(F.size("bands") > 0).select("rep", "bands", "code")
    alone = open_rows.where("members = 1 and rep <> pivot").select("key", "band", "rep", "n").join(signed, "rep")
    rows = written(alone.select("key", "rep", "n", F.slice("bands", F.lit(1), F.col("band")).alias("before"), "code"))
    x, y = rows.alias("x"), rows.alias("y")
    earlier = F.exists(F.zip_with("x.before", "y.before", lambda p, q: p == q), lambda e: e)
    agree = F.size(F.filter(F.zip_with("x.code", "y.code", lambda p, q: p == q), lambda e: e))
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
        & ~earlier
        & (agree >= least),
    )
    return _confirmed(written(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()), sets, percent)


BLOCK_MEMBERS, BLOCK_QUERIES = 512, 2048


def _against_components(open_rows: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A link from a class to a component of two or more with which it shares a bucket, if there is one.

    Of two components the larger (then the one with the greater id) is searched. Its members and the
    classes that ask are dealt into blocks of bounded size, and every block of members meets every block
    of classes in one call, which counts common shingles and returns at most one link per class.
    """
    targets = open_rows.where("members > 1").select("key", F.col("component").alias("target"), F.col("members").alias("target_members")).distinct()
    asked = (
        open_rows.alias("o")
        .join(targets.alias("t"), (F.col("o.key") == F.col("t.key")) & (F.struct("o.members", "o.component") < F.struct("t.target_members", "t.target")))
        .select("o.rep", "t.target", "t.target_members")
        .distinct()
    )
    asked = written(asked)
    load = written(asked.groupBy("target", "target_members").agg(F.count(F.lit(1)).alias("queries")))
    blocks = load.select(
        "target", F.ceil(F.col("target_members") / BLOCK_MEMBERS).cast("int").alias("nb"), F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("nq")
    )
    blocks = written(blocks)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = named.select("rep", F.col("component").alias("target")).join(blocks, "target").select("rep", "target", deal("rep", "nb").alias("b"), every("nq").alias("q"))
    queries = asked.join(blocks, "target").select("rep", "target", deal("rep", "nq").alias("q"), every("nb").alias("b"))

    def of(rows: DataFrame) -> DataFrame:
        own = sets.select(F.col("doc_id").alias("own_id"), F.col("shingles").alias("own"))
        joined = rows.join(own, F.col("rep") == F.col("own_id"))
        return joined.select(*(F.col(c).alias(c) for c in ("target", "b", "q", "rep")), F.col("own").alias("shingles"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        return linked_to_block(one, two, percent)

    grouped = of(members).groupBy("target", "b", "q").cogroup(of(queries).groupBy("target", "b", "q"))
    return grouped.applyInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_to_block(members: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """Per query the first member whose set is similar enough: ``a`` the query's id, ``b`` the member's."""
    out: tuple[list, list] = ([], [])
    if members.num_rows and queries.num_rows:
        ids = members.column("rep").to_numpy()
        column = members.column("shingles").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), sizes)
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        for rep, own in zip(queries.column("rep").to_pylist(), queries.column("shingles")):
            own = own.values.to_numpy()
            low = np.searchsorted(values, own, "left")
            count = np.searchsorted(values, own, "right") - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(ids))
            hit = np.flatnonzero(common * 100 >= percent * (sizes + len(own) - common))
            if len(hit):
                out[0].append(rep)
                out[1].append(int(ids[hit[0]]))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no other row stands for the group.

    Groups are those of :func:`near_duplicates`, but made of texts alone: rows that repeat a ``doc_id`` with
    another text are judged by their own text, and none leaves because of what its id's other text is like. Of
    rows equal in id and text one stays, the least by the other columns, which must have an order. Nulls, blank
    texts and rows without id stay. An empty table gives no rows.
    """
    judged = written(_judged(docs, k, percent, bands, rows, by_id=False).where("doc_id is not null"))
    id_, key, row = free_names(docs, "id", "key", "row")
    named = lambda found: found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    same = lambda found: (docs["doc_id"].cast("long") == found[id_]) & (text_key() == found[key])
    gone = named(judged.where("not kept")).distinct()
    rest = docs.join(gone, same(gone), "left_anti")
    twice = written(named(judged.where("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")))
    if twice.isEmpty():
        return rest
    equal = rest.join(twice, same(twice), "left_semi").groupBy(F.col("doc_id").alias(id_), F.coalesce("text", F.lit("")).alias(key))
    least = equal.agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias(row)).select(f"{row}.*")
    return rest.join(twice, same(twice), "left_anti").unionByName(least)
