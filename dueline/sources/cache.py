"""Tables kept under a key of what they were made from.

The key covers the plan and columns of each input, the files it reads (path, length,
time of change) and the caller's settings, so a changed log or setting finds nothing
under its key and is built anew; tables of other keys stay where they are. Functions
written in Python count by their names alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.sources.tables import is_complete

_PLAN_FIELDS = "spark.sql.debug.maxToStringFields"


def _plan_text(df: DataFrame) -> str:
    """The optimised plan without names and ids, and what its inputs are."""
    spark = df.sparkSession
    before = spark.conf.get(_PLAN_FIELDS)
    # Else a plan of many columns is cut short in its text.
    spark.conf.set(_PLAN_FIELDS, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        text = plan.canonicalized().toString()
        leaves = plan.collectLeaves()
        inputs = [_leaf(leaves.apply(i)) for i in range(leaves.size())]
    finally:
        spark.conf.set(_PLAN_FIELDS, before)
    return json.dumps([text, inputs, df.schema.json()])


def _leaf(leaf) -> str:
    kind = leaf.nodeName()
    if kind == "LogicalRelation" and hasattr(leaf.relation(), "location"):
        return leaf.relation().location().rootPaths().mkString("\n")
    if kind == "LocalRelation":
        return leaf.data().mkString("\n")
    if kind in ("Range", "OneRowRelation"):
        return kind
    # Rows held in memory have no identity that lasts: such a table is never found again.
    return uuid.uuid4().hex


def _files(df: DataFrame) -> list:
    """Number of input files and two sums of hashes of their paths, lengths and times."""
    names = df.inputFiles()
    if not names:
        return []
    # Names come as URIs; a reader takes them as patterns.
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(n)) for n in names]
    found = df.sparkSession.read.format("binaryFile").load(paths)
    facts = ["path", "length", "modificationTime"]
    sums = [
        F.sum(F.xxhash64(F.lit(seed), *facts).cast("decimal(38,0)")).cast("string") for seed in (1, 2)
    ]
    return list(found.select(*facts).agg(F.count("*"), *sums).first())


def content_key(inputs: list[DataFrame], settings: dict) -> str:
    """A key that changes with any input's plan, columns or files and with the settings."""
    parts = [[_plan_text(df), _files(df)] for df in inputs]
    told = json.dumps([parts, settings], sort_keys=True, default=repr)
    return hashlib.sha256(told.encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through the folder's own file system, replacing one left before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def kept_under(spark: SparkSession, folder: str, key: str, build: Callable[[str], None]) -> tuple[str, bool]:
    """The folder ``table`` of the key, and whether it had to be built.

    ``build`` gets the key's path and writes Parquet to its ``table`` last, whose mark of
    a finished write makes the entry valid; what a broken run left is overwritten.
    """
    path = f"{folder.rstrip('/')}/{key}"
    if is_complete(spark, f"{path}/table"):
        return path, False
    build(path)
    return path, True
