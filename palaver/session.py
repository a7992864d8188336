"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("palaver")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}  # fallback folder per local application


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a fresh temporary
    folder: on a cluster a machine-local path would be lost with its executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="palaver-")
    return _LOCAL[app]


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,

    so a lost executor re-reads the table instead of recomputing the branch.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks per core over which narrow rows are dealt before heavy work.
TASKS = 4


def spread(source: DataFrame, key: str, narrow: bool = False) -> DataFrame:
    """Spread a source over the cores before heavy text work.

    A file with a single row group is one task. Sources that already have a partition
    per core (any real table) are returned unchanged, without a shuffle. Only for plain
    scans: counting partitions must not run a job.

    ``narrow`` rows, a few numbers that texts are made from, are always dealt: partitions of a
    scan are cut by bytes, but a row group goes to one of them whole, and rows that take
    longer than their bytes tell would make a few long tasks. All columns deal them, so
    a key that repeats or is null gathers nothing but equal rows.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    there = source.rdd.getNumPartitions()
    if narrow:
        return source.repartition(max(there, TASKS * cores), *source.columns)
    return source if there >= cores else source.repartition(cores, key)
