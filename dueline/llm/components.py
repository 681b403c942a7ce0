"""Connected components of an edge table: large-star and small-star rounds.

Each round hangs neighbours on the smallest node around and writes the edges to
the shared folder, which cuts the lineage. Nothing but two numbers per round
comes to the driver. A hub with many neighbours is one row of its minimum and
many rows of a join, which Spark splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for nodes of (a, b) other than the smallest of their component."""
    a, b = F.col("a"), F.col("b")
    pairs = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, seen = staged(pairs.distinct(), "edges"), None
    while True:
        mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))
        found = tuple(now.agg(F.count("*"), mark).first())
        if found == seen or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(near, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        now = staged(small.unionByName(own).filter(F.col("u") != F.col("v")).distinct(), "edges")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes, for edges in memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new
