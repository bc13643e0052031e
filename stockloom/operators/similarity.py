"""Substitute scores, name similarity and category matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.prefix import row_positions
from stockloom.session import dealt_join, spread, written


def internal_substitute_score(alt: DataFrame) -> DataFrame:
    """Score and priority of alternative offers. Columns with ``pref_`` hold the preferred offer."""

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.least(F.lit(1.0), F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0.0))

    raw = 0.5 * ratio("availability", "pref_availability") + 0.25 * ratio("pref_lead_time", "lead_time") + 0.25 * ratio("pref_price", "price")
    order = [F.col("availability").desc(), F.col("lead_time").asc(), F.col("price").asc(), F.col("supplier_id").asc()]
    scored = alt.withColumn("score", F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)))
    return row_positions(scored, ["product_id"], order, "priority").withColumn("priority", F.col("priority").cast("int"))


def _tokens(products: DataFrame, name: str) -> DataFrame:
    """Normalised TF-IDF weights of each distinct name; document frequencies count every product."""
    names = products.groupBy(name).agg(F.count(F.lit(1)).alias("_mult"))
    words = F.regexp_extract_all(F.lower(name), F.lit(r"\b\w\w+\b"), 0)
    tf = names.select(name, "_mult", F.explode(words).alias("token")).groupBy(name, "_mult", "token").agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy("token").agg(F.sum("_mult").alias("_df"))
    n = products.agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(df, "token").withColumn("_w", F.col("_tf") * (F.log((1 + n.scalar()) / (1 + F.col("_df"))) + 1))
    norm = w.groupBy(name).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norm, name).select(name, "token", "_df", (F.col("_w") / F.col("_norm")).alias("w"))


def tfidf_name_similarity(
    products: DataFrame, product: str, category: str, name: str, pack: str, k: int = 3, min_score: float = 0.7, low: float = 0.8, high: float = 1.25,
    rows: int = 500_000,
) -> DataFrame:
    """The k most similar products of the same category with a pack ratio strictly inside (low, high).

    Similarity is worked out between distinct names, never between products. Names of one category meet
    only through a rare token: tokens are ordered from rare to common, and a pair that reaches the score
    must share one of the leading tokens of both, because the rest of a name alone is too short for it.
    A group of equal (category, name, pack) offers its k + 1 smallest ids, enough for every product that
    leaves itself out. Joins are dealt to tasks that make some ``rows`` rows, whatever the number of products.
    """
    usable = products.where(F.col(pack) > 0).select(product, category, name, F.col(pack).cast("double").alias(pack))
    weights = _tokens(products.select(name), name)
    entry = F.array_sort(F.collect_list(F.struct(F.col("_df"), F.col("token"), F.col("w"))))
    vec = weights.groupBy(name).agg(entry.alias("v"))
    # A name is short, so its vector is a small array. Lead tokens: those from which the tail still reaches the score.
    positions = F.sequence(F.lit(1), F.size("v"))
    tail = F.transform(positions, lambda i: F.aggregate(F.slice("v", i, F.size("v")), F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    lead = F.filter(F.arrays_zip(F.transform("v", lambda e: e["token"]).alias("t"), tail.alias("s")), lambda z: z["s"] >= min_score * min_score - 1e-9)
    # One row per distinct name, read three times below.
    vec = written(vec.withColumn("lead", F.transform(lead, lambda z: z["t"])))
    members = usable.select(category, name).distinct().join(vec, name)
    probes = members.select(category, name, F.explode("lead").alias("token"))
    met = (
        probes.alias("a").join(probes.alias("b"), [category, "token"])
        .select(category, F.col(f"a.{name}").alias("_na"), F.col(f"b.{name}").alias("_nb")).distinct()
    )
    va = vec.select(F.col(name).alias("_na"), F.col("v").alias("_va"))
    vb = vec.select(F.col(name).alias("_nb"), F.map_from_entries(F.transform("v", lambda e: F.struct(e["token"], e["w"]))).alias("_vb"))
    dot = F.aggregate("_va", F.lit(0.0), lambda acc, e: acc + e["w"] * F.coalesce(F.try_element_at(F.col("_vb"), e["token"]), F.lit(0.0)))
    alike = met.join(va, "_na").join(vb, "_nb").withColumn("score", dot).where(F.col("score") >= min_score).select(category, "_na", "_nb", "score")

    first = F.row_number().over(Window.partitionBy(category, name, pack).orderBy(product))
    heads = usable.withColumn("_rn", first).where(F.col("_rn") <= k + 1)
    # Packs meet through buckets one ratio wide, so only close sizes are compared.
    bucket = F.floor(F.log(F.col(pack)) / F.log(F.lit(max(high, 1 / low))))
    offer = written(heads.select(category, F.col(name).alias("_nb"), F.col(pack).alias("_pb"), bucket.alias("_bucket"), F.col(product).alias("substitute_id")))
    order = [F.desc(F.round("score", 9)), "substitute_id"]

    def leading(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k + 1).drop("_rn")

    # What a name is offered in one pack, from all names like it: a pack is close to another or not, so k + 1 of them are enough.
    shown, tasks = dealt_join(offer, written(alike), [category, "_nb"], "substitute_id", rows)
    seen = shown.select(category, "_na", "_bucket", "_pb", "substitute_id", "score").repartition(tasks, category, "_na", "_bucket", "_pb")
    seen = written(leading(seen, category, "_na", "_bucket", "_pb"))
    groups = usable.select(category, name, pack).distinct()
    seek = written(groups.select(category, F.col(name).alias("_na"), F.col(pack).alias("_pa"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket")))
    ratio = F.col("_pb") / F.col("_pa")
    close, _ = dealt_join(seek, seen, [category, "_na", "_bucket"], "_pa", rows)
    # First the best of each bucket, where the join left them; then, of three buckets, the best of all.
    found = leading(close.where((ratio > low) & (ratio < high)), category, "_na", "_bucket", "_part", "_pa")
    found = spread(found.select(category, F.col("_na").alias(name), F.col("_pa").alias(pack), "substitute_id", "score"), category, name, pack, rows=rows)
    best = written(leading(found, category, name, pack))
    each, tasks = dealt_join(usable, best, [category, name, pack], product, rows)
    each = each.where(F.col("substitute_id") != F.col(product)).select(product, "substitute_id", "score").repartition(tasks, product)
    rank = F.row_number().over(Window.partitionBy(product).orderBy(*order))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(product, "substitute_id", "score", "rank")


def _grams(names: DataFrame, col: str, q: int) -> DataFrame:
    """``col, length, gram``: the runs of ``q`` letters of each name; a run that comes again has the number of its coming."""
    runs = F.when(F.length(col) >= q, F.transform(F.sequence(F.lit(1), F.length(col) - (q - 1)), lambda i: F.substring(F.col(col), i, F.lit(q)))).otherwise(F.array())
    with_runs = names.select(col, F.length(col).alias("length"), runs.alias("_g"))
    numbered = F.transform("_g", lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice("_g", F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    return with_runs.select(col, "length", F.explode(numbered).alias("gram"))


def _rarest(grams: DataFrame, counts: DataFrame, col: str, q: int, most: float) -> DataFrame:
    """Of each name the rarest grams, as many as a partner within ``most`` cannot all lack."""
    shared = F.ceil(F.col("length") * (1 - q * most)) - q + 1  # grams that two names of this length or more must share
    kept = (F.col("length") - q + 1) - shared + 1
    order = Window.partitionBy(col).orderBy(F.coalesce("n", F.lit(0)), "gram")
    ranked = grams.where(shared > 0).join(counts, "gram", "left").withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= kept).select(col, "length", "gram")


def near_names(values: DataFrame, targets: DataFrame, col: str, target: str, q: int, most: float) -> DataFrame:
    """``col, b``: the best ``target`` within ``most`` of each name as struct ``d, t``; names without one have no row.

    Names at edit distance e, whose longer one has m letters, share m - q + 1 - q e grams or more. So at a relative
    distance of up to ``most`` two names share one of their rarest grams, and meet in an index of these alone.
    Names too short to owe a gram are left out: take a smaller ``q`` for them. Every pair that meets is measured.
    """
    grams = written(_grams(targets, target, q))
    counts = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    a = _rarest(_grams(values, col, q), counts, col, q, most)
    b = _rarest(grams, counts, target, q, most).withColumnRenamed("length", "_length")
    longer, shorter = F.greatest("length", "_length"), F.least("length", "_length")
    met = a.join(b, "gram").where(longer - shorter <= most * longer).select(col, target, longer.alias("_m")).distinct()
    measured = met.withColumn("_e", F.levenshtein(col, target)).where(F.col("_e") <= most * F.col("_m"))
    return measured.groupBy(col).agg(F.min(F.struct((F.col("_e") / F.col("_m")).alias("d"), F.col(target).alias("t"))).alias("b"))


# Letters in a gram and the relative distance up to which its index answers, one after the other.
STEPS = [(2, 0.25), (1, 0.5)]


def fuzzy_category_match(source: DataFrame, targets: DataFrame, col: str, target: str, accept: float = 0.75, chunk: int = 1000) -> DataFrame:
    """Best target for each value without an exact one: 1 - edit distance / longer length, and SI or REVISAR.

    Indexes of grams find every target up to a relative distance, close ones first; a value whose best target is
    within it is settled, and only the others go on to the wider index. Values with no target within half of
    the longer length resemble none; they meet all targets, packed into arrays of about ``chunk`` values, so memory
    is bounded by a chunk. Of equal distances the first target counts. Nulls match nothing; an empty value is at
    distance 1 from every target. Without targets there are no rows.
    """
    names = written(targets.select(F.col(target).alias("_t")).where("_t is not null").distinct())
    open_ = written(source.select(col).where(F.col(col).isNotNull()).distinct().join(names, F.col(col) == F.col("_t"), "left_anti"))
    found = []
    for q, most in STEPS:
        best = written(near_names(open_, names, col, "_t", q, most))
        found.append(best)
        open_ = written(open_.join(best, col, "left_anti"))
    out = _scanned(open_, names, col, chunk)
    for best in found:
        out = out.unionByName(best)
    score = 1 - F.col("b.d")
    return out.select(col, F.col("b.t").alias("suggested"), score.alias("score"), F.when(score >= accept, "SI").otherwise("REVISAR").alias("use"))


def _scanned(values: DataFrame, names: DataFrame, col: str, chunk: int) -> DataFrame:
    """``col, b``: the best of all targets, chunk by chunk."""
    n_chunks = names.agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.lit(1)).cast("long").alias("n"))
    packed = names.withColumn("_c", F.pmod(F.xxhash64("_t"), n_chunks.scalar())).groupBy("_c").agg(F.collect_list("_t").alias("_ts"))
    seek = values.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks.scalar() - 1)))
    longer = lambda x: F.greatest(F.length(col), F.length(x), F.lit(1))
    scored = F.transform("_ts", lambda x: F.struct((F.levenshtein(F.col(col), x) / longer(x)).alias("d"), x.alias("t")))
    return seek.join(packed, "_c").select(col, F.array_min(scored).alias("b")).groupBy(col).agg(F.min("b").alias("b"))
