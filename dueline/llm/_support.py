"""Staging, key ranges and Arrow batches, shared by the operators here."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import dueline
from dueline.session import scratch_path

#: Rows and bytes of one Arrow batch.
BATCH_ROWS = 3000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold small.

    Workers also look for the package where the driver has it; on a cluster it
    comes with ``--py-files`` or is installed.
    """
    env = spark.sparkContext.environment
    root = str(Path(dueline.__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones, whatever else the table has."""
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )


def with_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with two hashes of id and text, and all columns in ``row``.

    The hashes stand for a row wherever it is joined: they need no null-safe
    comparison, and rows that agree in both have the same id and text.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.col(f"`{doc_id}`").cast("long")
    return docs.select(
        F.xxhash64(number, body).alias("one"),
        F.xxhash64(body, F.lit(1), number).alias("two"),
        number.alias("doc_id"),
        body.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def in_blocks(df: DataFrame, key: str, parts: int, known: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_block``: ranges of ``key``, ascending, nulls in the first.

    The cut points are approximate quantiles, at most ``parts - 1`` numbers. A
    block is a function of the key alone, so a rerun task finds the same rows.
    ``known`` is a table with the same keys that is cheaper to read.
    """
    low = float("-inf")
    number = F.coalesce(F.col(key).cast("double"), F.lit(low))
    cuts: list[float] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        keys = (known or df).select(F.col(key).cast("double").alias("_key"))
        cuts = sorted(set(keys.approxQuantile("_key", shares, 1 / (4 * parts))))
    if not cuts:
        return df.withColumn("_block", F.lit(0))
    split = Bucketizer(
        splits=[low, *cuts, float("inf")], inputCol="_number", outputCol="_bucket", handleInvalid="keep"
    )
    out = split.transform(df.withColumn("_number", number))
    return out.withColumn("_block", F.col("_bucket").cast("int")).drop("_number", "_bucket")


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def lean(keep: str | None = None) -> None:
    """Give back what earlier tasks of this worker hold, but for one table of words.

    Spark uses a worker again for whatever comes next, and what a worker has freed
    stays with the process until it is trimmed.
    """
    if words := sys.modules.get("dueline.llm.words"):
        words.forget(keep)
    pa.default_memory_pool().release_unused()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)


def map_batches(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
    schema: str,
    words: str | None = None,
) -> DataFrame:
    """``mapInArrow`` for a function that yields columns by name.

    ``words`` is the tokenizer file whose table of words the function uses.
    """
    bounded_batches(df.sparkSession)
    wanted = arrow_schema(T.StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(words)
        for columns in run(batches):
            arrays = [
                columns[f.name]
                if isinstance(columns[f.name], pa.Array) and columns[f.name].type == f.type
                else pa.array(columns[f.name], f.type)
                for f in wanted
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)
        lean(words)

    return df.mapInArrow(go, schema)


def running_position(
    df: DataFrame, group: list[str], keys: list[Column], size: Column, name: str
) -> DataFrame:
    """``df`` with the sum of ``size`` over the rows before this one in its group."""
    return running_sums(df, group, keys, {name: size})


def running_sums(
    df: DataFrame, group: list[str], keys: list[Column], sizes: dict[str, Column]
) -> DataFrame:
    """``df`` with sums over the rows before this one in its group, by name.

    Rows are cut into ranges of (group, keys), written, and summed inside their
    range; what lies before a range comes from one row per group and range. No
    task holds more than a range, however large a group is. ``keys`` must order
    the rows of a group fully; equal rows may then swap places.
    """
    spark = df.sparkSession
    by_group = [F.col(g) for g in group]
    ranged = df.repartitionByRange(partitions(spark), *by_group, *keys)
    cut = staged(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by_group, "_range").agg(*[F.sum(s).alias(f"_size_{n}") for n, s in sizes.items()])
    before = totals.select(
        *[F.col(g).alias(f"_key_{g}") for g in group],
        F.col("_range").alias("_key"),
        *[F.coalesce(F.sum(f"_size_{n}").over(earlier), F.lit(0)).alias(f"_below_{n}") for n in sizes],
    )
    same = F.col("_range") == F.col("_key")
    for g in group:
        same = same & (F.col(g) == F.col(f"_key_{g}"))
    inside = Window.partitionBy(*group, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.coalesce(F.sum(s).over(inside), F.lit(0)) for n, s in sizes.items()}
    joined = cut.join(before, same)
    return joined.select(*df.columns, *[(F.col(f"_below_{n}") + v).alias(n) for n, v in local.items()])
