"""Domain tables derived from the given star-schema tables, in DataFrame code and in SQL.

Every DataFrame method of :class:`Tables` has a CTE of the same name, so a query and its SQL
counterpart start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators import calendar as cal
from stockloom.session import summed, written
from stockloom.sources.io import read_parquet_source


class Tables:
    """Lazy access to the source tables of one folder and the domain tables bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def source(self, name: str) -> DataFrame:
        return read_parquet_source(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.source("lineitem")

    @cached_property
    def part(self) -> DataFrame:
        return self.source("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.source("orders")

    @cached_property
    def events(self) -> DataFrame:
        return self.source("events")

    @cached_property
    def sales(self) -> DataFrame:
        """One row per order line: the raw demand, with repeated (product, date) keys."""
        return self.lineitem.select(
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("date"),
            F.col("l_quantity").alias("qty"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_returnflag").alias("flag"),
        )

    @cached_property
    def demand(self) -> DataFrame:
        """One row per product and day. All series operators work on it, so a product holds at
        most one row per calendar day whatever the number of order lines behind it."""
        return summed(self.sales, {"product_id": F.col("product_id"), "date": F.col("date")}, {"qty": F.col("qty")}, F.col("order_id"))

    @cached_property
    def catalog(self) -> DataFrame:
        size = F.col("p_size")
        return self.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            size.alias("pack_size"),
            F.col("p_retailprice").alias("price"),
            F.when(size <= 10, " Inactivo").when(size <= 30, "ACTIVO ").otherwise("activo").alias("status"),
            (F.col("p_partkey") % 4).cast("int").alias("cluster_id"),
            F.concat(F.lit("S"), (F.col("p_partkey") % 10).cast("string")).alias("supplier"),
        )

    @cached_property
    def lookup(self) -> DataFrame:
        """Product to cluster, missing for the largest packs."""
        return self.catalog.where(F.col("pack_size") <= 45).select("product_id", "cluster_id")

    @cached_property
    def demand_clustered(self) -> DataFrame:
        return self.demand.join(self.catalog.select("product_id", "cluster_id", "price"), "product_id")

    @cached_property
    def cluster_days(self) -> DataFrame:
        return self.demand_clustered.groupBy("cluster_id", "date").agg(F.sum("qty").alias("qty"))

    @cached_property
    def offers(self) -> DataFrame:
        cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
        keys = {"product_id": F.col("l_partkey"), "supplier_id": F.col("l_suppkey")}
        return summed(self.lineitem, keys, {"cents": cents, "availability": F.col("l_quantity")}, F.col("l_orderkey")).select(
            "product_id",
            "supplier_id",
            (F.col("cents") / F.col("availability") / 100).alias("price"),
            "availability",
            (2 + F.col("supplier_id") % 14).cast("int").alias("lead_time"),
            (1 + F.col("supplier_id") % 3).cast("int").alias("priority"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Customer order lines with every column that makes their order total."""
        o = self.orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
        return self.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "order_date",
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("qty"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        return self.catalog.select(
            "product_id", "name", "category", "supplier", (F.col("pack_size") * 20).cast("long").alias("stock")
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """Demand of 2000 moved to 2001, without the leap day."""
        src = self.demand_clustered.where(F.year("date") == 2000)
        return src.where(F.date_format("date", "MM-dd") != "02-29").select(
            "product_id", "cluster_id", F.add_months("date", 12).alias("date"), F.col("qty").alias("y_pred")
        )

    @cached_property
    def years(self) -> DataFrame:
        """The few years present. Written as a table, so that calendars do not scan the sales again."""
        return written(self.sales.select(F.year("date").alias("year")).distinct())

    @cached_property
    def real_events(self) -> DataFrame:
        """About 130 rows per year, written as a dimension table."""
        return written(cal.real_event_calendar(self.years))

    @cached_property
    def event_windows(self) -> DataFrame:
        """First and last day of each event per year, as the observed windows."""
        return self.real_events.groupBy("year", "event").agg(F.min("date").alias("start"), F.max("date").alias("end"))

    @cached_property
    def daily_total(self) -> DataFrame:
        return self.sales.groupBy("date").agg(F.sum("qty").alias("total"))

    @cached_property
    def substitutes_external(self) -> DataFrame:
        """Three candidate substitutes per product with a score from the keys, written once: every reader would count the parts again."""
        n = self.part.agg(F.count(F.lit(1)).alias("n"))
        step = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
        return written(
            self.part.select(F.col("p_partkey").alias("product_id"), n.scalar().alias("n"), step.alias("k"))
            .select(
                "product_id",
                ((F.col("product_id") + F.col("k") * 7) % F.col("n")).alias("substitute_id"),
                (((F.col("product_id") * 31 + F.col("k") * 17) % 100) / 100.0).alias("score"),
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """Error of two simple forecasts per cluster and year, the shape of a back-test table."""
        y = self.demand_clustered.groupBy("cluster_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
            F.sum("qty").alias("qty")
        )
        prev = y.select("cluster_id", (F.col("year") + 1).alias("year"), "month", F.col("qty").alias("prev"))
        both = y.join(prev, ["cluster_id", "year", "month"])
        models = F.explode(F.array(F.lit("NAIVE"), F.lit("SARIMAX_A")))
        pred = F.when(F.col("model") == "NAIVE", F.col("prev")).otherwise(F.col("prev") * 1.25)
        return (
            both.withColumn("model", models)
            .groupBy("model", "cluster_id", "year")
            .agg((100 * F.sum(F.abs(F.col("qty") - pred)) / F.sum("qty")).alias("wape"))
        )


CTES: dict[str, tuple[str, str]] = {
    "sales": (
        "",
        """SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS qty,
           l_suppkey AS supplier_id, l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag AS flag
           FROM lineitem""",
    ),
    "demand": ("sales", "SELECT product_id, date, sum(qty) AS qty FROM sales GROUP BY product_id, date"),
    "catalog": (
        "",
        """SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
           p_size AS pack_size, p_retailprice AS price,
           CASE WHEN p_size <= 10 THEN ' Inactivo' WHEN p_size <= 30 THEN 'ACTIVO ' ELSE 'activo' END AS status,
           CAST(p_partkey % 4 AS INTEGER) AS cluster_id, 'S' || CAST(p_partkey % 10 AS VARCHAR) AS supplier
           FROM part""",
    ),
    "lookup": ("catalog", "SELECT product_id, cluster_id FROM catalog WHERE pack_size <= 45"),
    "demand_clustered": (
        "demand catalog",
        "SELECT d.product_id, d.date, d.qty, c.cluster_id, c.price FROM demand d JOIN catalog c USING (product_id)",
    ),
    "cluster_days": (
        "demand_clustered",
        "SELECT cluster_id, date, sum(qty) AS qty FROM demand_clustered GROUP BY cluster_id, date",
    ),
    "offers": (
        "",
        """SELECT l_partkey AS product_id, l_suppkey AS supplier_id,
           CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS DOUBLE) / sum(l_quantity) / 100 AS price,
           sum(l_quantity) AS availability, CAST(2 + l_suppkey % 14 AS INTEGER) AS lead_time,
           CAST(1 + l_suppkey % 3 AS INTEGER) AS priority
           FROM lineitem GROUP BY l_partkey, l_suppkey""",
    ),
    "order_lines": (
        "",
        """SELECT CAST(o_orderdate AS DATE) AS order_date, l_orderkey AS order_id, l_linenumber AS line_no,
           l_suppkey AS supplier_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "inventory": (
        "catalog",
        "SELECT product_id, name, category, supplier, CAST(pack_size * 20 AS BIGINT) AS stock FROM catalog",
    ),
    "forecast": (
        "demand_clustered",
        """SELECT product_id, cluster_id, CAST(date + INTERVAL 12 MONTH AS DATE) AS date, qty AS y_pred
           FROM demand_clustered WHERE year(date) = 2000 AND strftime(date, '%m-%d') <> '02-29'""",
    ),
    "years": ("", "SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem"),
    "feasts": (
        "years",
        """SELECT year, easter, black_friday, CAST(black_friday + 3 AS DATE) AS cyber_monday, last_friday, blue_monday,
           prime_day FROM (
             SELECT year,
               make_date(year, (h + l - 7*m + 114)//31, 1 + (h + l - 7*m + 114) % 31) AS easter,
               CAST(make_date(year,11,1) + CAST((12 - isodow(make_date(year,11,1))) % 7 + 21 AS INTEGER) AS DATE) AS black_friday,
               CAST(make_date(year,11,30) - CAST((isodow(make_date(year,11,30)) + 2) % 7 AS INTEGER) AS DATE) AS last_friday,
               CAST(make_date(year,1,1) + CAST((8 - isodow(make_date(year,1,1))) % 7 + 14 AS INTEGER) AS DATE) AS blue_monday,
               CAST(make_date(year,7,1) + CAST((9 - isodow(make_date(year,7,1))) % 7 + 7 AS INTEGER) AS DATE) AS prime_day
             FROM (SELECT *, (a + 11*h + 22*l)//451 AS m FROM (
               SELECT *, (32 + 2*(b % 4) + 2*(c // 4) - h - (c % 4)) % 7 AS l FROM (
                 SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h FROM (
                   SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM years)))))""",
    ),
    "real_events": (
        "feasts",
        """SELECT DISTINCT event, CAST(day AS DATE) AS date, year FROM (
             SELECT year, event, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM (
               SELECT year, 'Festivo Nacional' AS event, make_date(year, md[1], md[2]) AS s, make_date(year, md[1], md[2]) AS e
               FROM feasts, (SELECT unnest([[1,1],[1,6],[5,1],[8,15],[10,12],[11,1],[12,6],[12,8],[12,25]]) AS md)
               UNION ALL SELECT year, 'Semana Santa', easter - 3, easter - 2 FROM feasts
               UNION ALL SELECT year, 'Rebajas Invierno', make_date(year,1,7), make_date(year,1,31) FROM feasts
               UNION ALL SELECT year, 'Rebajas Verano', make_date(year,7,1), make_date(year,7,31) FROM feasts
               UNION ALL SELECT year, 'San Valentín', make_date(year,2,14), make_date(year,2,14) FROM feasts
               UNION ALL SELECT year, 'Black Friday', black_friday, black_friday FROM feasts
               UNION ALL SELECT year, 'Cyber Monday', cyber_monday, cyber_monday FROM feasts
               UNION ALL SELECT year, 'Prime Day', prime_day, prime_day + 1 FROM feasts
               UNION ALL SELECT year, 'Navidad', make_date(year,12,20), make_date(year,12,31) FROM feasts
               UNION ALL SELECT year, 'Vuelta al cole', make_date(year,9,1), make_date(year,9,15) FROM feasts
               UNION ALL SELECT year, 'Agosto', make_date(year,8,1), make_date(year,8,31) FROM feasts))""",
    ),
    "event_windows": (
        "real_events",
        'SELECT year, event, min(date) AS start, max(date) AS "end" FROM real_events GROUP BY year, event',
    ),
    "daily_total": ("sales", "SELECT date, sum(qty) AS total FROM sales GROUP BY date"),
    "substitutes_external": (
        "",
        """SELECT p_partkey AS product_id, (p_partkey + k * 7) % (SELECT count(*) FROM part) AS substitute_id,
           CAST((p_partkey * 31 + k * 17) % 100 AS DOUBLE) / 100 AS score
           FROM part, (SELECT unnest([1, 2, 3]) AS k)""",
    ),
    "metrics": (
        "demand_clustered",
        """SELECT model, a.cluster_id, a.year,
             100 * sum(abs(a.qty - CASE WHEN model = 'NAIVE' THEN b.qty ELSE b.qty * 1.25 END)) / sum(a.qty) AS wape
           FROM (SELECT cluster_id, CAST(year(date) AS INTEGER) AS year, month(date) AS month, sum(qty) AS qty
                 FROM demand_clustered GROUP BY ALL) a
           JOIN (SELECT cluster_id, CAST(year(date) AS INTEGER) AS year, month(date) AS month, sum(qty) AS qty
                 FROM demand_clustered GROUP BY ALL) b
             ON a.cluster_id = b.cluster_id AND a.month = b.month AND a.year = b.year + 1,
           (SELECT unnest(['NAIVE', 'SARIMAX_A']) AS model) GROUP BY model, a.cluster_id, a.year""",
    ),
}


def with_ctes(names: list[str], body: str) -> str:
    """``body`` behind the CTEs it names and those they depend on, each once and in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0].split():
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body
