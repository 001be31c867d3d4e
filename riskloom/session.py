"""Session settings and the shared staging folder.

Intermediate results that several jobs read are written once as Parquet below
``spark.checkpoint.dir``.  A written table cuts the lineage, survives the loss
of executors, keeps column pruning, and pins every value that later jobs use.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str = "local[*]", app: str = "riskloom", **conf: object) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever their working folder is; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(home.rglob("*.py")):
            packed.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared staging folder the cluster names; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[app]


def staged(df: DataFrame, label: str = "table") -> tuple[str, DataFrame]:
    """Write ``df`` once; where it is, and the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table."""
    return staged(df, label)[1]


#: A lookup side of at most so many narrow rows is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup side if its counted rows are few; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row result to every row as literals."""
    row = one_row.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema})


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a table with fewer input splits than the cluster has cores over all cores.

    Large tables have many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


#: Rows that a task of a wide sort takes, so that it sorts them in memory.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash a large table over tasks of about ``TASK_ROWS`` rows, ahead of a sort or join by ``keys``.

    The session's shuffle width is fixed; a table that outgrows it would spill every sort.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > width else df


def gathered(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash a table by ``keys``, always; what later steps derive per row is then not shuffled."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > width else df.repartition(*keys)


def wide_buckets(spark: SparkSession) -> int:
    """How many value buckets a global ordering uses: it follows the cluster's shuffle width."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(4096, 2 * width))
