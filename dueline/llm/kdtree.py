"""Shards of near equal bytes from a k-d tree over document metadata.

A node is split along the dimension in which its rows lie widest, at the median
weighted with their sizes, until it holds no more than the target bytes. Medians
are exact: the rows of a level are sorted by (node, coordinate) in ranges, and a
row knows the bytes before it from its range and one total per range. Only slim
rows (no texts) are shuffled, once per level; nothing runs in a single task and
the driver sees one row per node.

Ties in the coordinate go by a hash of the row, so a value that a third of the
rows have is split as well. Null texts have no bytes; null metadata lies at the
low end of its dimension. Repeated rows are kept each. An empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import running_position, staged

#: Dimensions of the metadata: text columns lie where a hash puts their value.
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")


def coordinate(df: DataFrame, name: str) -> Column:
    """A number for a metadata column; longer scales are taken as logarithms."""
    value = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        return F.coalesce(F.crc32(value).cast("double"), F.lit(-1.0))
    if name == "n_chars":
        return F.coalesce(F.log1p(F.greatest(value, F.lit(0)).cast("double")), F.lit(-1.0))
    return F.coalesce(value.cast("double"), F.lit(float(-(2**63))))


def rows_of(docs: DataFrame, dimensions: tuple[str, ...], doc_id: str, text: str) -> DataFrame:
    """Slim rows: id, size, digest, coordinates and a hash that breaks ties."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    present = [d for d in dimensions if d in docs.columns]
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.array(*[coordinate(docs, d) for d in present]).alias("at"),
        F.xxhash64(F.col(f"`{doc_id}`"), body).alias("tie"),
        F.lit(0).alias("node"),
    )


def _shares(leaves: int) -> tuple[int, int]:
    return leaves // 2, leaves - leaves // 2


def split_evenly(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` with ``node`` from 0 to ``leaves - 1``, near equal in size.

    Each level splits every node that stands for more than one leaf; a node's
    bytes go to its children in proportion to their leaves.
    """
    width = rows.select(F.size("at").alias("n")).first()
    if width is None or leaves < 2:
        return rows
    ends = [
        f(F.col("at")[i]).alias(f"{name}{i}")
        for i in range(width["n"])
        for name, f in (("lo", F.min), ("hi", F.max))
    ]
    todo = {0: leaves}
    whole = None
    while any(n > 1 for n in todo.values()):
        # One row per node, at most as many as there are leaves.
        seen = rows.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()
        if whole is None:
            whole = [max(seen[0][f"hi{i}"] - seen[0][f"lo{i}"], 1e-300) for i in range(width["n"])]
        plan = []
        for r in seen:
            n = todo.get(r["node"], 1)
            spread = [(r[f"hi{i}"] - r[f"lo{i}"]) / whole[i] for i in range(width["n"])]
            left, right = _shares(n)
            plan.append(
                (r["node"], spread.index(max(spread)), r["size"] * left / n if left else -1.0, right if left else 0)
            )
        level = rows.sparkSession.createDataFrame(
            plan, "_node int, _axis int, _cut double, _step int"
        )
        placed = rows.join(F.broadcast(level), F.col("node") == F.col("_node")).withColumn(
            "_at", F.expr("at[_axis]")
        )
        keys = [F.col("_at"), F.col("tie"), F.col("doc_id"), F.col("text_crc32")]
        placed = running_position(placed, ["node"], keys, F.col("size"), "_before")
        # A row belongs where its middle lies.
        right = (F.col("_cut") >= 0) & (F.col("_before") + F.col("size") / 2 >= F.col("_cut"))
        left_leaves = {node: _shares(n)[0] for node, n in todo.items() if n > 1}
        shift = F.coalesce(
            *[F.when(F.col("node") == k, F.lit(v)) for k, v in left_leaves.items()], F.lit(0)
        )
        rows = staged(
            placed.withColumn("node", F.when(right, F.col("node") + shift).otherwise(F.col("node"))).select(
                *rows.columns
            ),
            "nodes",
        )
        todo = {
            child: n
            for node, leaves_of in todo.items()
            for child, n in (
                [(node, leaves_of)]
                if leaves_of < 2
                else [(node, _shares(leaves_of)[0]), (node + _shares(leaves_of)[0], _shares(leaves_of)[1])]
            )
        }
    return rows


def sharded(
    docs: DataFrame,
    shards: int | None = 16,
    target_bytes: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Shard, and place in the shard by doc_id, of every document.

    With ``target_bytes`` there are as many shards as bring leaves to that size.
    """
    rows = staged(rows_of(docs, dimensions, doc_id, text), "metadata")
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    leaves = split_evenly(rows, shards)
    keys = [F.col("doc_id"), F.col("tie"), F.col("text_crc32")]
    numbered = running_position(leaves, ["node"], keys, F.lit(1), "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("node").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
