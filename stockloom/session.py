"""Session set-up and the one place that decides where checkpoints live."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stockloom") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller passes its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STOCKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(made)
    return made


def written(df, write: dict[str, str] | None = None, **options: str):
    """``df`` as a Parquet table in the shared folder (with writer options ``write``), read back (with reader ``options``): its lineage ends here.

    A table is computed once (an eager ``checkpoint()`` computes its last stage twice), later reads take
    only the columns they need, and in loops no constraints of earlier rounds are carried along.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**(write or {})).parquet(path)
    out = df.sparkSession.read.options(**options).schema(df.schema).parquet(path)
    out._written_at = path
    _tables.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return out


def spread(df, *keys: str, rows: int = 100_000):
    """``df`` written, and dealt by ``keys`` to so many tasks that each has about ``rows`` rows, whatever the table's size.

    For rows that grow many times in the task that reads them: small rows would else be packed into few tasks.
    """
    table = written(df)
    return table.repartition(table.count() // rows + 1, *keys)


def dealt_join(a, b, keys: list[str], apart: str, rows: int = 500_000):
    """``a`` joined with ``b`` on ``keys`` where no task makes many more than ``rows`` rows, whatever the tables' size; and how many tasks that takes.

    For joins that make many rows of few: small tables would else be packed into few tasks. A key with more rows than that
    meets in parts of ``a``, told apart by a hash of its column ``apart``. Both tables are read twice.
    """
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    sizes = written(sizes.select(*keys, (F.col("_n") * F.col("_m")).alias("_made")))
    tasks = (sizes.agg(F.sum("_made")).first()[0] or 0) // rows + 1
    cut = sizes.where(F.col("_made") > rows).select(*keys, F.ceil(F.col("_made") / rows).alias("_cuts"))
    cuts = F.coalesce("_cuts", F.lit(1).cast("long"))
    left = a.join(cut, keys, "left").withColumn("_part", F.pmod(F.xxhash64(apart), cuts)).drop("_cuts")
    right = b.join(cut, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))).drop("_cuts")
    by = [*keys, "_part"]
    return left.repartition(tasks, *by).join(right.repartition(tasks, *by), by), tasks


def summed(df, keys: dict, sums: dict, line, rows: int = 500_000):
    """The ``sums`` of ``df`` per ``keys`` (names to columns), where no task holds more than about ``rows`` rows, whatever the table's size.

    A task would else keep as many keys as its split or its share of a fixed number of partitions has. Large tables are
    summed twice, first in parts of a key told apart by ``line``, so that a frequent key is no task's alone.
    """
    names = list(keys)
    lines = df.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(s) for s, c in sums.items()], F.pmod(F.xxhash64(line), F.lit(16)).alias("_apart"))
    added = [F.sum(s).alias(s) for s in sums]
    tasks = df.count() // rows + 1
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return lines.groupBy(*names).agg(*added)
    parts = lines.repartition(tasks, *names, "_apart").groupBy(*names, "_apart").agg(*added)
    return parts.repartition(tasks, *names).groupBy(*names).agg(*added)


_tables: dict[str, list[str]] = {}


def discard(spark: SparkSession, *frames) -> None:
    """Deletes the tables behind frames that :func:`written` returned and nothing reads any more, as a loop's last round."""
    own = _tables.get(spark.sparkContext.applicationId, [])
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path in own:
            own.remove(path)
            remove(spark, path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Owns all tables written inside: they are deleted at the end, when the caller has stored its result."""
    own = _tables.setdefault(spark.sparkContext.applicationId, [])
    before = set(own)
    try:
        yield
    finally:
        for path in [p for p in own if p not in before]:
            own.remove(path)
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote to the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
