"""Near-duplicate embeddings by cross-polytope hashing.

A vector is padded to a power of two and rotated three times by random signs and
a fast Hadamard transform; its hash is the axis, with its sign, that is nearest.
``HASHES`` of them make a bucket. In each of ``TABLES`` tables a vector stands in
its own bucket and looks into those that replace an axis by the next nearest ones
(multiprobe). Vectors that meet are compared by cosine in double precision.

Vectors are grouped with their label, and equal vectors of a label are one class
with a count, so copies are not compared. A pair that meets in several buckets is
counted in the first: both vectors carry their buckets, so a worker can tell. It
returns link counts and a forest per bucket, never pairs. A bucket with more than
``MOST_ROWS`` rows is cut into blocks, and each pair of blocks is a task's work.

Vectors that are null, zero, or hold null or non-finite components, and vectors
without a label, are linked with nothing. Vectors of unequal length are not
compared. Rows without a vec_id take part in links.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import map_batches, partitions, staged
from dueline.llm.components import components, roots

SIMILARITY = 0.93
TABLES, HASHES, PROBES = 5, 2, 3
_AXES = 3  # nearest axes that probes choose from
MOST_ROWS = 4096
_BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Buckets of unit vectors: (vector, table, probe), the own bucket first."""
    n, dim = x.shape
    size = 1 << max(dim - 1, 1).bit_length()
    padded = np.zeros((n, size))
    padded[:, :dim] = x
    axes = min(_AXES, size)
    choices = list(itertools.product(range(axes), repeat=hashes))
    out = np.empty((n, tables, min(probes, len(choices))), np.int64)
    for t in range(tables):
        nearest, lengths = [], []
        for k in range(hashes):
            signs = np.random.default_rng([t, k, size]).choice([-1.0, 1.0], (3, size))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :axes]
            value = np.take_along_axis(y, top, 1)
            nearest.append(2 * top + (value < 0))
            lengths.append(np.abs(value))
        loss = np.stack(
            [sum((v[:, 0] - v[:, c]) ** 2 for v, c in zip(lengths, choice, strict=True)) for choice in choices], 1
        )
        code = np.zeros((n, len(choices)), np.int64)
        for i, choice in enumerate(choices):
            for a, c in zip(nearest, choice, strict=True):
                code[:, i] = code[:, i] * 2 * size + a[:, c]
        best = np.argsort(loss, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def met_before(a: np.ndarray, b: np.ndarray, table: int, kind: np.ndarray) -> np.ndarray:
    """Whether pairs met in an earlier table, or in this one in an earlier way.

    Ways are, in order: in the own bucket of both, in that of the first, in that
    of the second; ``kind`` is the way of this meeting.
    """
    own = a[:, :, 0] == b[:, :, 0]
    first = (a[:, :, :1] == b[:, :, 1:]).any(axis=2)
    second = (b[:, :, :1] == a[:, :, 1:]).any(axis=2)
    ways = np.stack([own, first, second], axis=2)
    seen = ways[:, :table].any(axis=(1, 2))
    here = ways[:, table]
    return seen | (here[:, 0] & (kind > 0)) | (here[:, 1] & (kind > 1))


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their class (null if linked with nothing), and the classes."""
    e = F.col("embedding")
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{embedding}`").alias("embedding"),
        F.col(f"`{label}`").alias("label"),
    )
    big = F.lit(float("inf"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    fit = F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    marked = rows.withColumn("class", F.when(F.coalesce(fit, F.lit(False)), F.xxhash64("label", "embedding")))
    known = marked.filter(F.col("class").isNotNull())
    classes = known.groupBy("class", "label", "embedding").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("smallest")
    )
    return marked.select("vec_id", "class"), classes


_MEET = "key long, class long, copies long, label long, at int, probe int, codes binary, vector binary"


def _placed(classes: DataFrame) -> DataFrame:
    """One row per class, table and probe, keyed by label, length, table and bucket."""

    def run(batches):
        for batch in batches:
            ids, copies, rows, groups = (batch.column(i) for i in range(4))
            sizes = np.array([len(r) for r in rows.to_pylist()])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                raw = [rows[int(i)].as_py() for i in at]
                codes = buckets(unit(raw))
                n, tables, probes = codes.shape
                packed = [c.tobytes() for c in codes]
                # As floats of the input or doubles: no digit is lost.
                values = [np.array(r, np.float64).tobytes() for r in raw]
                label = groups.to_numpy()[at]
                for t in range(tables):
                    for p in range(probes):
                        mixed = (label * 31 + t * 7919 + dim * 104729) * 1000003 + codes[:, t, p]
                        yield {
                            "key": mixed,
                            "class": ids.to_numpy()[at],
                            "copies": copies.to_numpy()[at],
                            "label": label,
                            "at": np.full(n, t),
                            "probe": np.full(n, p),
                            "codes": packed,
                            "vector": values,
                        }

    slim = classes.select("class", "copies", F.col("embedding").cast("array<double>"), F.xxhash64("label"))
    return map_batches(slim, run, _MEET)


def _bucket_links(rows: list[tuple], similarity: float) -> dict | None:
    """Link counts and a forest for the rows of one bucket or pair of blocks."""
    _, ids, copies, labels, tables, probes, codes, values, blocks, one, two = zip(*rows, strict=True)
    ids, copies, probe = np.array(ids), np.array(copies), np.array(probes)
    # A key stands for one label and table but for a clash of hashes; clashes are
    # told by the whole hash of the label and by the codes.
    label = np.array(labels)
    table, block = np.array(tables), np.array(blocks)
    x = unit([np.frombuffer(v) for v in values])
    code = np.stack([np.frombuffer(c, np.int64).reshape(TABLES, -1) for c in codes])
    own = np.flatnonzero(probe == 0)
    lefts, rights = [], []
    for s in range(0, len(own), _BLOCK):
        mine = own[s : s + _BLOCK]
        i, j = np.nonzero(x[mine] @ x.T >= similarity)
        i = mine[i]
        # Two own rows once; an own row with the probing rows of others.
        good = (ids[i] != ids[j]) & ((probe[j] > 0) | (ids[i] < ids[j])) & (table[i] == table[j])
        good &= label[i] == label[j]
        good &= (block[i] != block[j]) | (one[0] == two[0])
        lefts.append(i[good])
        rights.append(j[good])
    i, j = np.concatenate(lefts or [own]), np.concatenate(rights or [own])
    if not len(i):
        return None
    t = table[i]
    here = code[i, t, 0] == code[j, t, probe[j]]
    i, j, t = i[here], j[here], t[here]
    swap = ids[i] > ids[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    kind = np.where(probe[j] == 0, 0, np.where(swap, 2, 1))
    new = np.ones(len(i), bool)
    for each in np.unique(t):
        at = np.flatnonzero(t == each)
        for s in range(0, len(at), 100_000):
            some = at[s : s + 100_000]
            new[some] = ~met_before(code[a[some]], code[b[some]], int(each), kind[some])
    a, b = a[new], b[new]
    if not len(a):
        return None
    nodes, place = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    links = np.bincount(left, copies[b], len(nodes)) + np.bincount(right, copies[a], len(nodes))
    return {"class": nodes, "links": links.astype(np.int64), "root": nodes[roots(len(nodes), left, right)]}


def links(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(class, links, root): parts of link counts, and edges that join classes."""
    spark = classes.sparkSession
    rows = staged(_placed(classes), "placed")
    # Slim: only keys with more rows than a task should hold.
    hot = rows.groupBy("key").count().filter(F.col("count") > MOST_ROWS)
    hot = hot.select("key", F.ceil(F.col("count") / MOST_ROWS).cast("int").alias("blocks"))
    joined = rows.join(staged(hot, "hot"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    copies = joined.withColumn("block", block).select(
        *rows.columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = (
        copies.withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
        .drop("other")
        .repartition(partitions(spark), "key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
    )

    def run(batches):
        held, current = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mark = (row[0], row[9], row[10])
                if mark != current:
                    if len(held) > 1 and (found := _bucket_links(held, similarity)):
                        yield found
                    held, current = [], mark
                held.append(row)
        if len(held) > 1 and (found := _bucket_links(held, similarity)):
            yield found

    return map_batches(dealt, run, "class long, links long, root long")


def near_duplicates(
    vectors: DataFrame,
    similarity: float = SIMILARITY,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows, classes = classes_of(vectors, vec_id, embedding, label)
    classes = staged(classes, "classes")
    found = staged(links(classes, similarity), "links")
    tree = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("links").alias("others"))
    rooted = (
        classes.select("class", "copies", "smallest")
        .join(tree.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    least = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labelled = rooted.join(least, "root").join(counts, "class", "left")
    of_class = labelled.select(
        "class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = F.col("class").isNull()
    out = rows.join(of_class, "class", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
