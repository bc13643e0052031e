"""Groups spelling variants: words one letter apart, found through an index of grams of variable length.

Two words at distance one agree left of the edited place and right of it. Grams of a word that reach over
that place are affected by the edit, all others are in both words, at the same distance from the left end
or from the right end. For each place where a word can be edited, the lists of its rarest unaffected grams
on both sides are merged, that is: looked up together, and every pair found is verified letter by letter.

A gram is as long as it must be to be rare: at each place of a word it is lengthened while it is in the
dictionary of frequent grams. The dictionary decides how long the lists are, never what is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import LOWER, pieces, text_batches
from stockloom.session import discard, written

LEAST_POINTS = 5
LEAST_COUNT = 3
LONGEST_GRAM = 8
DICTIONARY = 200_000
HELD_WORDS = 200_000
_WORD = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(LOWER.tolist())


def word_counts(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, slip_every: int | None = None) -> DataFrame:
    """``word, n``: words of at least ``least_points`` letters that occur ``least_count`` times or more in all texts.

    Words are maximal runs of ``A-Z``, ``a-z`` and the letters from U+00C0 to U+00FF, of which only ``A-Z`` are
    lower-cased. With ``slip_every``, a word of a document loses one letter if that number divides the checksum
    of ``<doc_id>:<word>``, which tests the grouping on known slips. Counts are added up in the tasks first.
    """

    def counted(batches):
        held: Counter[str] = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for piece in pieces(batches):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text")):
                if not text.is_valid:
                    continue
                found = Counter(_WORD.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode()))
                if slip_every:
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    slips = [(w, h) for w in found if not (h := zlib.crc32(w.encode(), seed)) % slip_every]
                    moved = [(w[: h % len(w)] + w[h % len(w) + 1 :], found.pop(w)) for w, h in slips]
                    for w, n in moved:
                        held[w] += n
                held.update(found)
            if len(held) > HELD_WORDS:
                yield out()
        yield out()

    rows = text_batches(docs).select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return rows.where(F.char_length("word") >= least_points).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame, longest: int = LONGEST_GRAM, most: int = DICTIONARY) -> dict[str, int]:
    """The most frequent grams of 2 to ``longest - 1`` letters of all words, at most ``most`` of them.

    Words are marked at both ends. Grams that are not in it are rare. With a gram, each beginning of it
    is in the dictionary too, as it is at least as frequent and comes first among equals.
    """
    grams = F.expr(f"flatten(transform(sequence(2, {longest - 1}), q -> if(char_length(p) < q, array(), transform(sequence(1, char_length(p) - q + 1), i -> substring(p, i, q)))))")
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("p")).select(F.explode(grams).alias("gram"))
    frequent = marked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {r.gram: r.n for r in frequent.orderBy(F.desc("n"), F.char_length("gram"), "gram").limit(most).collect()}


def decomposed(marked: str, frequent: dict[str, int], longest: int = LONGEST_GRAM) -> list[tuple[int, str, int, int]]:
    """The gram ``(frequency or 0, letters, start, end)`` at each place of a marked word."""
    out, n = [], len(marked)
    for a in range(n - 1):
        b = a + 2
        while b < n and b - a < longest and marked[a:b] in frequent:
            b += 1
        out.append((frequent.get(marked[a:b], 0), marked[a:b], a, b))
    return out


def lookups(word: str, frequent: dict[str, int], longest: int = LONGEST_GRAM) -> tuple[set[int], set[int]]:
    """Keys of the merged lists of a word: for a letter replaced or left out, and for a letter put in.

    Per place of an edit, grams over it are affected. What stands left of the place is decomposed as if it
    ended there, so the gram at the border is cut and not lost; grams on the right need no cut. Of both
    sides the rarest gram counts, with its distance from the end of its side. Places with the same two grams
    share one key, so the number of keys is bounded by the affected grams, not by the letters.
    """
    marked = f"^{word}$"
    n = len(marked)
    grams = decomposed(marked, frequent, longest)
    left: list[tuple | None] = [None] * (n + 1)
    ends: dict[int, tuple] = {}
    for g in grams:
        if g[3] not in ends or g < ends[g[3]]:
            ends[g[3]] = g
    best, cut = None, 0
    for b in range(2, n):
        whole = ends.get(b)
        if whole is not None and (best is None or whole < best):
            best = whole
        while cut < b - 1 and grams[cut][3] <= b:
            cut += 1
        border = (frequent.get(marked[cut:b], 0), marked[cut:b], cut, b) if cut < b - 1 else None
        left[b] = min((g for g in (best, border) if g is not None), default=None)
    right: list[tuple | None] = [None] * (n + 1)
    last = None
    for frequency, letters, a, _ in reversed(grams):
        g = (frequency, letters, n - a)
        last = g if last is None or g < last else last
        right[a] = last

    def key(rest: int, x: tuple | None, y: tuple | None) -> int:
        named = f"{rest}|{x[1]}|{x[2]}" if x else f"{rest}||"
        return xxhash.xxh64_intdigest(f"{named}|{y[1]}|{y[2]}" if y else named) - (1 << 63)

    gone = {key(n - 3, left[i], right[i + 1]) for i in range(1, n - 1)}
    put = {key(n - 2, left[i], right[i]) for i in range(1, n)}
    return gone, put


def near_words(words: DataFrame, frequent: dict[str, int], longest: int = LONGEST_GRAM) -> DataFrame:
    """``word, n, near, near_n``: all pairs of ``words(word, n)`` one inserted, left-out or replaced letter apart, both ways.

    Lists are joined on their key: words with one letter gone among each other, and with words that have a
    letter more. Spark splits a long list over tasks. Each pair found is verified by its edit distance.
    """

    def listed(batches):
        for batch in batches:
            keys, gone, owner = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                for is_gone, own in zip((True, False), lookups(word, frequent, longest)):
                    keys.extend(own)
                    gone.extend([is_gone] * len(own))
                    owner.extend([i] * len(own))
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(gone, pa.bool_()), batch.column("word").take(who), batch.column("n").take(who)], names=["key", "gone", "word", "n"]
            )

    lists = written(words.repartition("word").mapInArrow(listed, "key long, gone boolean, word string, n long"))
    longer = lists.where("gone").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    shorter = lists.withColumn("points", F.char_length("word"))
    met = shorter.join(longer, "key").where("if(gone, word < near, points < char_length(near)) and levenshtein(word, near, 1) = 1")
    pairs = met.select("word", "n", "near", "near_n").distinct()
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def with_roots(words: DataFrame) -> DataFrame:
    """``words(word, form, ...)`` with ``root``: where following the forms ends, the word itself without a form.

    Each round replaces what a word points to by what that points to, so chains halve. Forms must not go in a ring.
    """
    spark = words.sparkSession
    points = written(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = points.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(points.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(spark, points)
        points = step
        if step.where("moved").limit(1).count() == 0:
            break
    return words.join(points.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(words: DataFrame, times: int = 2, longest: int = LONGEST_GRAM, most: int = DICTIONARY) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each of ``words(word, n)``.

    ``n_near`` counts the words one letter apart. A word's form is the most frequent of these (of equal ones the
    first in code-point order) if it is at least ``times`` as frequent; ``root`` follows the forms to the last.
    ``times`` must be above 1, so that forms never go in a ring. Words are distinct and not null; without words
    there are no rows. The dictionary of at most ``most`` grams is all that is sent to the tasks.
    """
    if times <= 1:
        raise ValueError("times must be above 1")
    words = written(words.select("word", "n"))
    links = near_words(words, gram_dictionary(words, longest, most), longest)
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    formed = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    return with_roots(formed)
