"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.columns import free_names
from stockloom.operators.prefix import range_running_total
from stockloom.session import written

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"

# Relative weight of a source over training time 0..1, by its place in the cycle of weights: the first
# kind fades, the second stays, the third grows. Between the knots a weight runs straight.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Words to take per source: ``source, kind, source_size, target``.

    ``sizes`` has one row per (source, size). The total of all sizes is shared by weight; a source stops
    at ``most`` times its size and the excess goes to the others by weight until none is above. That is
    the one level L with sum(min(weight * L, most * size)) = total. Sources are ordered by the level at
    which they stop; running sums of what the stopped ones take give, per source, the level of the rest,
    and the least such level at which nobody else stops is L. Sums are whole numbers until the last division.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = range_running_total(sources, [], [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "place")
    kinds = placed.select(
        "source",
        "source_size",
        ((F.col("place") - 1) % len(weights)).cast("int").alias("kind"),
    ).withColumn("weight", F.element_at(F.lit(list(weights)), F.col("kind") + 1).cast("long"))
    stop = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    lower = range_running_total(kinds, [], stop, F.col("source_size"), "stopped_size")
    lower = written(range_running_total(lower, [], stop, F.col("weight"), "stopped_weight"))
    totals = lower.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    # the level if this source and all that stop before it have stopped, and the level at which it stops itself
    with_totals = lower.crossJoin(F.broadcast(totals))  # a single row
    left = F.col("total") - most * F.col("stopped_size")
    levels = with_totals.select(
        "*",
        left.alias("left"),
        (F.col("all_weight") - F.col("stopped_weight")).alias("left_weight"),
    )
    # sources stop up to the last one whose own stop level is below the level of those that remain
    own = most * F.col("source_size")
    before_left = F.col("left") + own
    before_weight = F.col("left_weight") + F.col("weight")
    stops = own * before_weight < before_left * F.col("weight")
    last = levels.where(stops).agg(
        F.max(F.struct(F.col("stopped_weight"), "left", "left_weight")).alias("at")
    )
    level = last.crossJoin(F.broadcast(totals)).select(
        F.coalesce("at.left", "total").alias("num"), F.coalesce("at.left_weight", "all_weight").alias("den"), F.coalesce("at.stopped_weight", F.lit(0)).alias("reached")
    )
    joined = lower.crossJoin(F.broadcast(level))  # a single row
    target = F.when(F.col("stopped_weight") <= F.col("reached"), (most * F.col("source_size")).cast("double")).otherwise(
        F.try_divide(F.col("weight") * F.col("num").cast("double"), F.col("den").cast("double"))
    )
    return joined.select("source", "kind", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _areas(schedule: tuple) -> list[float]:
    """Integral of the schedule up to each knot, by trapezoids."""
    out = [0.0]
    for i in range(1, len(KNOTS)):
        out.append(out[-1] + (KNOTS[i] - KNOTS[i - 1]) * (schedule[i] + schedule[i - 1]) / 2)
    return out


def demanded_until(kind: Column, share: Column, schedules=SCHEDULES) -> Column:
    """The time 0..1 at which a source of this kind has been asked for ``share`` (0..1) of its words.

    The inverse of the normalised integral of its schedule: the segment is found among the areas at the
    knots, and inside it w0*x + (w1-w0)/(2*d)*x*x = rest is solved in the form that also holds for w1 = w0.
    """
    out = F.lit(None).cast("double")
    for n, schedule in enumerate(schedules):
        areas = _areas(schedule)
        area = share * areas[-1]
        at = F.lit(1.0)
        for i in reversed(range(len(KNOTS) - 1)):
            w0, w1, d = schedule[i], schedule[i + 1], KNOTS[i + 1] - KNOTS[i]
            rest = F.greatest(area - areas[i], F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2.0 * rest * ((w1 - w0) / d), F.lit(0.0)))
            inside = F.lit(KNOTS[i]) + F.coalesce(F.try_divide(2.0 * rest, w0 + root), F.lit(0.0))
            at = F.when(area <= areas[i + 1], F.least(inside, F.lit(KNOTS[i + 1]))).otherwise(at)
        out = F.when(kind % len(schedules) == n, at).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES, seed: str = "") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, placements``.

    A source's documents stand in a fixed random order (by md5 of the id and ``seed``) and form a stream
    of words that is read round and round until the source's target is reached: every document once per
    full round, and those at the start once more, the last one in part. ``placements`` is an array of
    ``(epoch, words, position)``: the words read in that round, and the training time 0..1 at which the
    source's weight schedule, integrated over time, has asked for the stream up to the middle of them.
    Running totals are cut by order ranges, so a hot source is spread over all tasks.

    Nulls: a null text has size 0 and is not placed (no placements), as are empty texts; a null source is
    a source of its own, the last one; rows without id come last in their source. Repeated rows are
    documents of their own. If all sizes are 0 all targets are 0. An empty table gives no rows. Further
    columns are ignored.
    """
    sized = written(
        docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    )
    targets = written(source_targets(sized, weights, most))
    keyed = sized.withColumn("spot", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("spot").asc(), F.col("doc_id").asc_nulls_last(), F.col("size").asc()]
    streams = range_running_total(keyed, ["source"], order, F.col("size"), "until")
    joined = streams.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.until", "t.kind", "t.source_size", "t.target", F.floor(F.col("t.target") + 0.5).alias("words")
    )
    start = F.col("until") - F.col("size")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)

    def placement(epoch: Column) -> Column:
        read = F.least(F.col("size"), F.greatest(F.lit(0), F.col("words") - epoch * F.col("source_size") - start)).cast("long")
        middle = epoch * F.col("source_size") + start + read / 2
        share = F.least(F.coalesce(F.try_divide(middle, F.col("words").cast("double")), F.lit(0.0)), F.lit(1.0))
        return F.struct(epoch.cast("int").alias("epoch"), read.alias("words"), demanded_until(F.col("kind"), share, schedules).alias("position"))

    placements = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), rounds.cast("long")), placement), lambda p: p["words"] > 0)
    rows = joined.withColumn("placements", placements)
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "placements")


def training_order(mixed: DataFrame) -> DataFrame:
    """``doc_id, source, epoch, words, position``: one row per placement, range-sorted by position."""
    rows = mixed.select("doc_id", "source", "size", F.explode("placements").alias("p"))
    flat = rows.select("doc_id", "source", "size", "p.epoch", "p.words", "p.position")
    return flat.orderBy("position", "source", "epoch", "doc_id")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix reads them, in training order.

    Whole documents only: a placement that reads at least half of its document's words is one row, a
    smaller one is none, unless it is the only one of its source. Rows that repeat a ``doc_id`` are read in turn and so share the same placements.
    Rows without id are numbered by nothing and cannot be placed again; they stay once if they have words.
    """
    mixed = mixed_documents(docs, **how)
    words = F.floor(F.col("target") + 0.5)  # a placement of all words of the target is the only one of its source
    read = mixed.select("doc_id", F.filter("placements", lambda p: (p["words"] * 2 >= F.col("size")) | (p["words"] == words)).alias("placements"))
    id_, places_, place = free_names(docs, "id", "places", "place")
    places = written(
        read.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.max("placements").alias(places_)).where(F.size(places_) > 0)
    )
    named = docs.join(places, docs["doc_id"] == places[id_]).select(*[docs[c] for c in docs.columns], F.explode(places_).alias(place))
    none = F.struct(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("words"), F.lit(1.0).alias("position"))
    unnamed = docs.where("doc_id is null").where(word_count(F.col("text")) > 0).withColumn(place, none)
    rows = named.unionByName(unnamed)
    at = F.col(place)
    return rows.orderBy(at["position"], "source", at["epoch"], "doc_id", F.xxhash64("text")).drop(place)


def row_order(mix: DataFrame) -> Column:
    """The place of each row of a stored mix: number of its part file and row in it; of other frames, the order they are held in."""
    try:
        mix.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    return F.struct(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long").alias("part"), name.alias("name"), F.col("_metadata.row_index").alias("row"))
