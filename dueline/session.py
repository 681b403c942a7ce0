"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes a task reads or gets from an exchange, instead of Spark's defaults.
_TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"),
}


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dueline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job here relies on, whoever made the session.

    Event times are wall clock times (``timestamp_ntz``), and differences of
    them are taken in the session zone, which therefore has no clock changes.
    AQE splits skewed join partitions and coalesces small ones. A task gets few bytes, as
    ids pack well and their hash tables and sorts take many times what is read; settings
    that differ from Spark's defaults are kept.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    for name, (default, smaller) in _TASK_BYTES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, smaller)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="dueline-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
