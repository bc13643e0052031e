"""Queries over outlier classification and statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from stockloom.operators import outliers as O
from stockloom.operators import stats as S
from stockloom.plans.bindings import CTES
from stockloom.plans.registry import query

YEARS = list(range(1995, 2002))


def _beta_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f) by Simpson's rule over the beta integral in its sine form."""
    return f"""(SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp((({d2}) - 1) * ln(greatest(sin(i * hi / 4000), 1e-300))
        + (({d1}) - 1) * ln(greatest(cos(i * hi / 4000), 1e-300)) + lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0))) * 2 * any_value(hi) / 12000
        FROM (SELECT i, asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f})))) AS hi FROM range(4001) r(i)))"""


def _normal_sql(z: str) -> str:
    """Two-sided tail of the normal distribution by Simpson's rule."""
    return f"(SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs({z}) + i / 400.0, 2) / 2)) * 2 / sqrt(2 * pi()) / 1200 FROM range(4001) r(i))"


def _chi2_sql(x: str) -> str:
    """The chi-square tail with six degrees of freedom, those of seven years."""
    return f"exp(-({x}) / 2) * (1 + ({x}) / 2 + pow(({x}) / 2, 2) / 2)"


def _p_of_r(r: str, sql: str) -> str:
    return f"SELECT *, {_beta_sql(f'{r} * {r} * (n - 2) / (1 - {r} * {r})', '1', 'n - 2')} AS p FROM ({sql})"

CTES["mad_flags"] = (
    "demand",
    """SELECT product_id, date, qty, year, robust_z, flag_z, flag_p99, flag_p95kmad, flag_z OR flag_p99 OR flag_p95kmad AS flag_any FROM (
      SELECT *, abs(robust_z) > 3.5 AS flag_z, qty > p99 AS flag_p99, CASE WHEN mad <= 1e-8 THEN qty > p99 ELSE qty > p95 AND qty > med + 4 * mad END AS flag_p95kmad FROM (
        SELECT *, CASE WHEN mad <= 1e-8 THEN 0 ELSE 0.6745 * (qty - med) / mad END AS robust_z FROM (
          SELECT *, median(abs(qty - med)) OVER (PARTITION BY product_id, year) AS mad FROM (
            SELECT product_id, date, qty, CAST(year(date) AS INTEGER) AS year, median(qty) OVER w AS med, quantile_cont(qty, 0.95) OVER w AS p95, quantile_cont(qty, 0.99) OVER w AS p99
            FROM demand WINDOW w AS (PARTITION BY product_id, year(date))))))""",
)


@query("mad_outlier_flags", "SELECT * FROM mad_flags", ctes="mad_flags", doubles="qty robust_z")
def _(t):
    return O.mad_outlier_flags(t.demand)


CTES["yearly_top"] = (
    "mad_flags",
    """SELECT *, year_total >= quantile_cont(year_total, 0.99) OVER (PARTITION BY year) OR row_number() OVER (PARTITION BY year ORDER BY year_total DESC, product_id) <= 5 AS is_top FROM (
       SELECT product_id, year, sum(qty) AS year_total, avg(CAST(flag_any AS DOUBLE)) AS share_flagged FROM mad_flags GROUP BY product_id, year)""",
)


@query("topn_per_year", "SELECT product_id, year, year_total, is_top FROM yearly_top", ctes="yearly_top", doubles="year_total")
def _(t):
    y = t.sales.groupBy("product_id", F.year("date").alias("year")).agg(F.sum("qty").alias("year_total"))
    return O.top_by_year(y, "year_total", "year", 5, 0.99)


@query(
    "classify_product_year",
    """SELECT product_id, year, year_total, share_flagged, kind, CASE kind WHEN 'top_venta' THEN 'sin_cambio' WHEN 'pico_aislado' THEN 'suavizado_a015' ELSE 'alerta_pendiente' END AS decision
       FROM (SELECT *, CASE WHEN is_top THEN 'top_venta' WHEN share_flagged < 0.05 THEN 'pico_aislado' ELSE 'mixto' END AS kind FROM yearly_top)""",
    ctes="yearly_top",
    doubles="year_total share_flagged",
)
def _(t):
    return O.classify_product_year(O.mad_outlier_flags(t.demand), top_n=5)


@query(
    "iqr_outliers",
    """SELECT product_id, date, qty, q3 > q1 AND (qty < q1 - 1.5 * (q3 - q1) OR qty > q3 + 1.5 * (q3 - q1)) AS is_outlier FROM (
       SELECT *, quantile_cont(qty, 0.25) OVER w AS q1, quantile_cont(qty, 0.75) OVER w AS q3 FROM demand WINDOW w AS (PARTITION BY product_id))""",
    ctes="demand",
    doubles="qty",
)
def _(t):
    return O.iqr_outliers(t.demand, "product_id", "qty")


CTES["pmeans"] = ("demand", "SELECT product_id, CAST(year(date) AS INTEGER) AS year, avg(qty) AS x FROM demand WHERE year(date) BETWEEN 1995 AND 2001 GROUP BY product_id, year(date)")
CTES["pwide"] = (
    "pmeans",
    f"""SELECT * FROM (SELECT product_id, {", ".join(f"max(x) FILTER (year = {y}) AS y{y}" for y in YEARS)} FROM pmeans GROUP BY product_id)
       WHERE {" AND ".join(f"y{y} IS NOT NULL" for y in YEARS)}""",
)
CTES["ppairs"] = (
    "pwide",
    " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, product_id, y{a} AS a, y{b} AS b FROM pwide" for a, b in combinations(YEARS, 2)),
)
CTES["plong"] = (
    "pwide",
    " UNION ALL ".join(f"SELECT product_id, {y} AS year, y{y} AS x FROM pwide" for y in YEARS),
)
_RANK = "rank() OVER ({0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {2}{1}) - 1) / 2.0::DOUBLE"


def means(t):
    return S.product_means(t.demand, "product_id", "date", "qty", YEARS)


def wide(t):
    return S.complete_products(means(t), "product_id", YEARS)


def pairs(t):
    return S.year_pairs(wide(t), "product_id", YEARS)


def long(t):
    both = means(t)
    return both.join(wide(t).select("product_id"), "product_id", "left_semi")


@query(
    "descriptive_stats_by_year",
    "SELECT year, count(*) AS n, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std, stddev_samp(x) / avg(x) AS cv, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM plong GROUP BY year",
    ctes="plong",
    doubles="mean median std cv iqr",
)
def _(t):
    return S.descriptive_stats_by_year(long(t))


@query(
    "pearson_by_year_pair",
    _p_of_r("pearson", """SELECT 'product' AS level, pair, corr(a, b) AS pearson, count(*) AS n FROM ppairs GROUP BY pair UNION ALL
       SELECT 'day', x.y || '-' || z.y, corr(x.v, z.v), count(*) FROM (SELECT year(date) AS y, strftime(date, '%m-%d') AS k, total AS v FROM daily_total) x
       JOIN (SELECT year(date) AS y, strftime(date, '%m-%d') AS k, total AS v FROM daily_total) z ON x.k = z.k AND x.y < z.y WHERE x.k <> '02-29' GROUP BY x.y, z.y"""),
    ctes="ppairs daily_total",
    doubles="pearson p",
)
def _(t):
    a = S.pearson_by_year_pair(pairs(t)).withColumn("level", F.lit("product"))
    b = S.pearson_by_year_pair(S.daily_curve_pairs(t.daily_total, "date", "total", YEARS)).withColumn("level", F.lit("day"))
    return a.unionByName(b)


@query(
    "spearman_by_year_pair",
    _p_of_r("spearman", f"""SELECT pair, corr(ra, rb) AS spearman, count(*) AS n FROM (SELECT pair, {_RANK.format("PARTITION BY pair", "a", "pair, ")} AS ra, {_RANK.format("PARTITION BY pair", "b", "pair, ")} AS rb FROM ppairs) GROUP BY pair"""),
    ctes="ppairs",
    doubles="spearman p",
)
def _(t):
    return S.spearman_by_year_pair(pairs(t))


_F = "SELECT *, " + _beta_sql("f", "df_between", "df_within") + """ AS p FROM (SELECT CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM (
   SELECT count(*) AS k, sum(gn)::BIGINT AS n, sum(gn * pow(gm - grand, 2)) AS ssb, sum(gss) AS ssw FROM (
     SELECT year, count(*) AS gn, avg(x) AS gm, var_pop(x) * count(*) AS gss, (SELECT avg(x) FROM {0}) AS grand FROM {0} GROUP BY year)))"""


@query("anova_oneway", _F.format("plong"), ctes="plong", doubles="f p")
def _(t):
    return S.anova_oneway(long(t), "year", "x")


CTES["pdev"] = ("plong", "SELECT year, abs(x - median(x) OVER (PARTITION BY year)) AS x FROM plong")


@query("levene_median", _F.format("pdev"), ctes="pdev", doubles="f p")
def _(t):
    return S.levene_median(long(t), "year", "x")


@query(
    "kruskal_wallis",
    f"""SELECT h, 7::BIGINT AS k, {_chi2_sql("h")} AS p FROM (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM plong GROUP BY x)) / (n * n * n - n)) AS h FROM (
        SELECT sum(rs * rs / gn) AS q, sum(gn)::DOUBLE AS n FROM (SELECT year, sum(r) AS rs, count(*) AS gn FROM (SELECT year, {_RANK.format("", "x", "")} AS r FROM plong) GROUP BY year)))""",
    ctes="plong",
    doubles="h p",
)
def _(t):
    return S.kruskal_wallis(long(t), "year", "x")


@query(
    "friedman",
    f"""SELECT chi AS chi2, n, {_chi2_sql("chi")} AS p FROM (SELECT (12.0 / (n * 56) * q - 24.0 * n) / (1 - ties / (n * 336)) AS chi, n FROM (
        SELECT sum(rs * rs) AS q, (SELECT count(*) FROM pwide) AS n, (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE FROM (SELECT count(*) AS c FROM plong GROUP BY product_id, x)) AS ties
        FROM (SELECT year, sum(r) AS rs FROM (SELECT year, {_RANK.format("PARTITION BY product_id", "x", "product_id, ")} AS r FROM plong) GROUP BY year)))""",
    ctes="plong",
    doubles="chi2 p",
)
def _(t):
    return S.friedman(wide(t), "product_id", YEARS)


@query(
    "wilcoxon_bonferroni",
    f"""SELECT *, {_normal_sql("z")} AS p, least(1, {_normal_sql("z")} * 21) AS p_bonferroni FROM (SELECT pair, n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM (
        SELECT pair, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(c * c - 1)::DOUBLE AS ties FROM (
          SELECT pair, d, {_RANK.format("PARTITION BY pair", "abs(d)", "pair, ")} AS r, count(*) OVER (PARTITION BY pair, abs(d)) AS c FROM (SELECT pair, a - b AS d FROM ppairs) WHERE d <> 0) GROUP BY pair))""",
    ctes="ppairs",
    doubles="w z p p_bonferroni",
)
def _(t):
    return S.wilcoxon_pairs(pairs(t))


@query(
    "dagostino_normality",
    """SELECT year, n::BIGINT AS n, z1 AS z_skew, z2 AS z_kurt, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS p FROM (
      SELECT year, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
        ((1 - 2 / (9 * a)) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM (
        SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM (
          SELECT year, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
            3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
            (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
            6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt
          FROM (SELECT year, count(*)::DOUBLE AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM (SELECT year, x, avg(x) OVER (PARTITION BY year) AS mu FROM plong) GROUP BY year))))""",
    ctes="plong",
    doubles="z_skew z_kurt k2 p",
)
def _(t):
    return S.dagostino_normality(long(t), "year", "x")
