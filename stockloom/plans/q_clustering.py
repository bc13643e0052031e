"""Queries over clustering, cluster quality and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import aggregates as A
from stockloom.operators import clustering as C
from stockloom.operators import density as N
from stockloom.operators import features as X
from stockloom.operators import hierarchy as H
from stockloom.operators import mixtures as G
from stockloom.operators import similarity as S
from stockloom.operators.silhouette import sampled_silhouettes
from stockloom.plans.bindings import CTES
from stockloom.plans.q_forecast import FEATS, scaled_features
from stockloom.plans.registry import query
from stockloom.session import written

KS = range(3, 11)


def brand_components(t):
    """Scores, loadings and shares of the principal components of the brands, over all years of sales."""
    df = t.sales.join(t.catalog.select("product_id", "brand"), "product_id")
    years = sorted(r[0] for r in t.sales.select(F.year("date")).distinct().collect())
    f = A.category_features(df, "brand", "date", "qty", years)
    return X.pca_scores(f, [c for c in f.columns if c != "brand"], ["brand"])


@query("pca_scores")
def _(t):
    return brand_components(t)[0]


@query("pca_loadings")
def _(t):
    """What every feature adds to each component."""
    return brand_components(t)[1]


@query("kmeans_sweep")
def _(t):
    return C.kmeans_sweep(scaled_features(t), FEATS, ["product_id"], KS)[0]


@query("kmeans_labels")
def _(t):
    """The cluster of every product for the number of clusters with the best silhouette."""
    return C.kmeans_sweep(scaled_features(t), FEATS, ["product_id"], KS)[1]


@query("kmeans_sweep_embeddings")
def _(t):
    e = t.source("embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return C.kmeans_sweep(wide, cols, ["vec_id"], [4, 8])[0]


@query("gmm_sweep")
def _(t):
    """Likelihood, BIC and silhouette of the mixtures of all four covariance kinds."""
    f = written(scaled_features(t))
    return G.mixture_table(f, "product_id", FEATS, G.fit_mixtures(f, "product_id", FEATS, KS))


@query("gmm_labels")
def _(t):
    """The component of every product under the mixture with the best silhouette."""
    f = written(scaled_features(t))
    models = G.fit_mixtures(f, "product_id", FEATS, KS)
    best = G.best_mixture(G.mixture_table(f, "product_id", FEATS, models), models)
    return G.mixture_labels(f, "product_id", FEATS, [best])


@query("hierarchical_merges")
def _(t):
    """Every merge of Ward's hierarchy with its height."""
    return H.ward_merges(scaled_features(t), "product_id", FEATS)


@query("hierarchical_labels")
def _(t):
    """The cluster of every product in Ward's hierarchy, for each number of clusters."""
    f = written(scaled_features(t))
    return H.ward_labels(f, "product_id", H.ward_merges(f, "product_id", FEATS), KS)


@query("hierarchical_clusters")
def _(t):
    """Silhouette and squared error of Ward's hierarchy for each number of clusters."""
    f = written(scaled_features(t))
    merges = H.ward_merges(f, "product_id", FEATS)
    labels = written(H.ward_labels(f, "product_id", merges, KS))
    error = labels.join(f, "product_id").groupBy("k", "cluster").agg(sum((F.var_pop(c) for c in FEATS), F.lit(0.0)).alias("v"), F.count(F.lit(1)).alias("n"))
    error = error.groupBy("k").agg(F.sum(F.col("v") * F.col("n")).alias("squared_error"))
    return error.join(sampled_silhouettes(labels, f, "product_id", FEATS, ["k"]), "k")


DENSITY = ["d_total", "cv", "p95"]
EPS, MIN_SAMPLES = [0.4, 0.5, 0.7, 1.0], [5, 10, 15]
_APART = " + ".join(f"pow(p.{c} - q.{c}, 2)" for c in DENSITY)
CTES["db_near"] = ("scaled", f"SELECT s.eps, p.product_id AS a, q.product_id AS b FROM scaled p, scaled q, (SELECT unnest({EPS})::DOUBLE AS eps) s WHERE {_APART} <= s.eps * s.eps")
CTES["db_core"] = ("db_near", f"SELECT eps, m AS min_samples, a FROM (SELECT eps, a, count(*) AS n FROM db_near GROUP BY ALL), (SELECT unnest({MIN_SAMPLES}) AS m) WHERE n >= m")
CTES["db_edge"] = (
    "db_core",
    "SELECT c.eps, c.min_samples, n.a, n.b FROM db_near n JOIN db_core c ON c.eps = n.eps AND c.a = n.a JOIN db_core e ON e.eps = n.eps AND e.min_samples = c.min_samples AND e.a = n.b",
)
CTES["db_component"] = (
    "db_edge",
    """WITH RECURSIVE lab(eps, min_samples, a, label) USING KEY (eps, min_samples, a) AS (SELECT eps, min_samples, a, a FROM db_core
         UNION SELECT e.eps, e.min_samples, e.a, min(l.label) FROM db_edge e JOIN lab l ON l.eps = e.eps AND l.min_samples = e.min_samples AND l.a = e.b
         JOIN recurring.lab r ON r.eps = e.eps AND r.min_samples = e.min_samples AND r.a = e.a WHERE l.label < r.label GROUP BY ALL)
       SELECT eps, min_samples, a, dense_rank() OVER (PARTITION BY eps, min_samples ORDER BY label) - 1 AS cluster FROM lab""",
)
CTES["db_labels"] = (
    "db_component",
    f"""SELECT p.product_id, e.eps, m.min_samples::INTEGER AS min_samples, CASE WHEN c.a IS NOT NULL THEN 'core' WHEN t.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
       coalesce(c.cluster, t.cluster, -1)::INTEGER AS cluster FROM scaled p CROSS JOIN (SELECT unnest({EPS})::DOUBLE AS eps) e CROSS JOIN (SELECT unnest({MIN_SAMPLES}) AS min_samples) m
       LEFT JOIN db_component c ON c.a = p.product_id AND c.eps = e.eps AND c.min_samples = m.min_samples
       LEFT JOIN (SELECT n.eps, c.min_samples, n.a, min(c.cluster) AS cluster FROM db_near n JOIN db_component c ON c.eps = n.eps AND c.a = n.b GROUP BY ALL) t ON t.a = p.product_id AND t.eps = e.eps AND t.min_samples = m.min_samples""",
)
CTES["db_counts"] = (
    "db_labels",
    """SELECT eps, min_samples, count(*) FILTER (role = 'core') AS core, count(*) FILTER (role = 'border') AS border, count(*) FILTER (role = 'noise') AS noise,
       (count(*) FILTER (role = 'noise'))::DOUBLE / count(*) AS noise_share, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM db_labels GROUP BY ALL""",
)
CTES["db_sample"] = ("scaled", "SELECT * FROM scaled ORDER BY md5(product_id || '|42'), product_id LIMIT 2000")
CTES["db_silhouette"] = (
    "db_labels db_sample",
    f"""SELECT eps, min_samples, avg(CASE WHEN n1 > 0 THEN (outer_ - inner_) / greatest(inner_, outer_) ELSE 0 END) AS silhouette FROM (
         SELECT eps, min_samples, product_id, max(m) FILTER (same) AS inner_, max(n) FILTER (same) - 1 AS n1, min(m) FILTER (NOT same) AS outer_ FROM (
           SELECT x.eps, x.min_samples, x.product_id, x.cluster = y.cluster AS same, sum(d) / greatest(count(*) - CAST(x.cluster = y.cluster AS INTEGER), 1) AS m, count(*) AS n
           FROM (SELECT p.product_id AS a, q.product_id AS b, sqrt({_APART}) AS d FROM db_sample p, db_sample q)
           JOIN db_labels x ON x.product_id = a JOIN db_labels y ON y.product_id = b AND y.eps = x.eps AND y.min_samples = x.min_samples
           GROUP BY x.eps, x.min_samples, x.product_id, x.cluster, y.cluster) GROUP BY ALL) GROUP BY ALL""",
)


def density_labels(t):
    return N.density_grid(written(scaled_features(t)), "product_id", DENSITY, EPS, MIN_SAMPLES)


@query("dbscan_noise", "SELECT * EXCLUDE (clusters) FROM db_counts", ctes="db_counts", doubles="noise_share")
def _(t):
    """Core, border and noise points for every radius and neighbour count."""
    counts = N.density_roles(scaled_features(t), "product_id", DENSITY, EPS, MIN_SAMPLES).groupBy("eps", "min_samples").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("core", "border", "noise")])
    return counts.withColumn("noise_share", F.col("noise") / (F.col("core") + F.col("border") + F.col("noise")))


@query("dbscan_clusters", "SELECT * FROM db_labels", ctes="db_labels")
def _(t):
    """Role and cluster of every product for every radius and neighbour count."""
    return density_labels(t)


@query(
    "dbscan_choice",
    """SELECT c.*, CASE WHEN clusters > 1 THEN silhouette END AS silhouette FROM db_counts c LEFT JOIN db_silhouette USING (eps, min_samples)
       ORDER BY CASE WHEN clusters > 1 THEN silhouette END DESC NULLS LAST, noise_share, clusters, eps, min_samples LIMIT 1""",
    ctes="db_counts db_silhouette",
    doubles="noise_share silhouette",
)
def _(t):
    """The radius and neighbour count with the best silhouette, then less noise, then fewer clusters."""
    f = written(scaled_features(t))
    return N.best_setting(N.explored(written(N.density_grid(f, "product_id", DENSITY, EPS, MIN_SAMPLES)), f, "product_id", DENSITY))


@query(
    "dbscan_noise_rows",
    f"SELECT product_id, cluster_id, {', '.join(FEATS)}, eps, min_samples FROM db_labels JOIN scaled USING (product_id) WHERE role = 'noise'",
    ctes="db_labels",
    doubles=" ".join(FEATS),
)
def _(t):
    """The products that are noise, with their features, for every radius and neighbour count."""
    roles = N.density_roles(scaled_features(t), "product_id", DENSITY, EPS, MIN_SAMPLES)
    return N.noise_rows(roles, scaled_features(t), "product_id")


_XS = ", ".join(FEATS)
CTES["sil_sample"] = ("scaled", f"SELECT product_id, cluster_id, {_XS} FROM scaled ORDER BY md5(product_id || '|42') LIMIT 1000")


@query(
    "silhouette_exact_sample",
    f"""SELECT avg(CASE WHEN n1 > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette, count(*) AS n FROM (
        SELECT product_id, max(m) FILTER (same) AS a, max(n) FILTER (same) AS n1, min(m) FILTER (NOT same) AS b FROM (
          SELECT p.product_id, p.cluster_id = q.cluster_id AS same, q.cluster_id, sum(sqrt({" + ".join(f"pow(p.{c} - q.{c}, 2)" for c in FEATS)})) / (count(*) - CAST(p.cluster_id = q.cluster_id AS INTEGER)) AS m, count(*) AS n
          FROM sil_sample p, sil_sample q GROUP BY p.product_id, p.cluster_id, q.cluster_id) GROUP BY product_id)""",
    ctes="sil_sample",
    doubles="silhouette",
)
def _(t):
    return C.silhouette_exact_sample(scaled_features(t), "product_id", "cluster_id", FEATS, n=1000)


_DIST = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEATS) + ")"
CTES["cents"] = ("scaled", "SELECT cluster_id, " + ", ".join(f"avg({c}) AS {c}" for c in FEATS) + " FROM scaled GROUP BY cluster_id")
CTES["scatter"] = ("scaled cents", f"SELECT cluster_id, avg({_DIST}) AS s FROM scaled a JOIN cents b USING (cluster_id) GROUP BY cluster_id")


@query(
    "davies_bouldin",
    f"""SELECT avg(r) AS davies_bouldin, count(*) AS k FROM (SELECT a.cluster_id, max((x.s + y.s) / {_DIST}) AS r FROM cents a JOIN cents b ON a.cluster_id <> b.cluster_id
        JOIN scatter x ON x.cluster_id = a.cluster_id JOIN scatter y ON y.cluster_id = b.cluster_id GROUP BY a.cluster_id)""",
    ctes="cents scatter",
    doubles="davies_bouldin",
)
def _(t):
    return C.davies_bouldin(scaled_features(t), "cluster_id", FEATS)


@query(
    "calinski_harabasz",
    "SELECT (ssb / (k - 1)) / (ssw / (n - k)) AS calinski_harabasz, k FROM (SELECT count(*) AS k, sum(n) AS n, sum(n * ("
    + " + ".join(f"pow({c} - (SELECT avg({c}) FROM scaled), 2)" for c in FEATS)
    + ")) AS ssb, sum(n * v) AS ssw FROM (SELECT cluster_id, count(*)::DOUBLE AS n, "
    + " + ".join(f"var_pop({c})" for c in FEATS)
    + " AS v, "
    + ", ".join(f"avg({c}) AS {c}" for c in FEATS)
    + " FROM scaled GROUP BY cluster_id))",
    ctes="scaled",
    doubles="calinski_harabasz",
)
def _(t):
    return C.calinski_harabasz(scaled_features(t), "cluster_id", FEATS)


CTES["named"] = ("catalog", "SELECT product_id, category, pack_size::DOUBLE AS pack, name || ' ' || brand AS label FROM catalog")
CTES["tok"] = (
    "named",
    """SELECT product_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS w FROM (
       SELECT t.product_id, t.token, tf * (ln((1 + (SELECT count(*) FROM named))::DOUBLE / (1 + df)) + 1) AS w FROM (SELECT product_id, token, count(*) AS tf FROM (SELECT product_id, unnest(regexp_extract_all(lower(label), '\\w\\w+')) AS token FROM named) GROUP BY ALL) t
       JOIN (SELECT token, count(DISTINCT product_id) AS df FROM (SELECT product_id, unnest(regexp_extract_all(lower(label), '\\w\\w+')) AS token FROM named) GROUP BY token) USING (token))""",
)


@query(
    "tfidf_name_similarity",
    """SELECT product_id, substitute_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(score, 9) DESC, substitute_id) AS rank FROM (
         SELECT a.product_id, b.product_id AS substitute_id, sum(x.w * y.w) AS score FROM named a JOIN named b ON a.category = b.category AND a.product_id <> b.product_id AND b.pack / a.pack > 0.8 AND b.pack / a.pack < 1.25
         JOIN tok x ON x.product_id = a.product_id JOIN tok y ON y.product_id = b.product_id AND y.token = x.token GROUP BY a.product_id, b.product_id) WHERE score >= 0.7) WHERE rank <= 3""",
    ctes="named tok",
    doubles="score",
)
def _(t):
    df = t.catalog.withColumn("label", F.concat_ws(" ", "name", "brand"))
    return S.tfidf_name_similarity(df, "product_id", "category", "label", "pack_size")


@query(
    "fuzzy_category_match",
    """SELECT label, t AS suggested, 1 - d AS score, CASE WHEN 1 - d >= 0.75 THEN 'SI' ELSE 'REVISAR' END AS "use" FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, t) AS rn FROM (
         SELECT s.label, g.t, levenshtein(s.label, g.t)::DOUBLE / greatest(length(s.label), length(g.t)) AS d FROM (SELECT DISTINCT lower(name) || substr(brand, 7) AS label FROM catalog) s, (SELECT DISTINCT lower(name) AS t FROM catalog) g)) WHERE rn = 1""",
    ctes="catalog",
    doubles="score",
)
def _(t):
    src = t.catalog.select(F.concat(F.lower("name"), F.substring("brand", 7, 9)).alias("label"))
    tgt = t.catalog.select(F.lower("name").alias("target"))
    return S.fuzzy_category_match(src, tgt, "label", "target", chunk=20)
