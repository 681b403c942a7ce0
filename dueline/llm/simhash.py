"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into ``most // 2 + 1`` segments, fewer than an index of
exact segments needs: of two fingerprints within ``most`` bits, one segment
differs by at most one bit. Every segment is therefore indexed once for each of
its bits, with that bit left out, and fingerprints that agree in a variant are
compared. Distinct fingerprints are indexed, so copies of a text count once.

Members of a variant are not paired with each other: a worker compares them in
blocks and returns a forest over those within reach, and forests are joined by
``components``. Null texts count as empty; texts without words have fingerprint
zero and are linked like others. Rows without a doc_id take part in links, and
rows that repeat are members each.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import map_batches, partitions, staged, texts_of, with_keys
from dueline.llm.components import components, roots

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: Up to so many members of a variant, all are compared at once.
FEW = 64
_ROWS = 200_000
_CHARS = 1_000_000


def fingerprints_of(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers."""
    counts, found = [], []
    digest = xxhash.xxh64_digest
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(words) <= shingle:
            found.append(digest(b" ".join(words), SEED) if words else b"")
            counts.append(1 if words else 0)
            continue
        whole = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
        found.append(
            b"".join([digest(whole[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)])
        )
        counts.append(len(starts))
    sizes = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum(sizes[some]) - sizes[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > sizes[some, None], axis=1)
        out[some] = packed.view(">u8")[:, 0]
    return out


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``bits``, the fingerprint as a signed long, in place of the last column, a text.

    No shuffle, and every other column as it was.
    """
    others = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            out, part, size = [], [], 0
            for t in batch.column(len(others)).to_pylist():
                part.append(t)
                size += len(t)
                if size > _CHARS:
                    out.append(fingerprints_of(part, shingle))
                    part, size = [], 0
            if part:
                out.append(fingerprints_of(part, shingle))
            done = np.concatenate(out).view(np.int64) if out else []
            yield {**{c: batch.column(i) for i, c in enumerate(others)}, "bits": done}

    kept = "".join(f"{c} long, " for c in others)
    return map_batches(rows, run, f"{kept}bits long")


def variant_masks(most: int = MOST_BITS) -> list[int]:
    """Signed masks, one per segment and left-out bit: 64 for any ``most`` above 1."""
    count = most // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    out = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        segment = (1 << high) - (1 << low)
        for bit in range(low, high):
            mask = segment & ~(1 << bit)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links_within(keys: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over rows that share a key and are within ``most`` bits.

    Rows are sorted by key. Edges are pairs of places.
    """
    edge = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(edge)
    sizes = np.diff(np.append(first, len(keys)))
    left, right = [], []
    small = np.repeat(sizes <= FEW, sizes)
    for step in range(1, int(min(FEW, sizes.max(initial=1)))):
        same = (keys[step:] == keys[:-step]) & small[step:]
        at = np.flatnonzero(same)
        if not len(at):
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= most]
        left.append(near)
        right.append(near + step)
    for f, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        # Members reached so far leave the rest, which each of them is held against.
        rest, reached = np.arange(f, f + n), []
        while len(rest):
            if not reached:
                reached.append(rest[0])
                rest = rest[1:]
            at = reached.pop()
            near = np.bitwise_count(bits[rest] ^ bits[at]) <= most
            hit = rest[near]
            left.append(np.full(len(hit), at))
            right.append(hit)
            reached.extend(hit.tolist())
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(keys: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, fingerprint) that join what the rows' keys join."""
    left, right = links_within(keys, bits, most)
    if not len(left):
        return left, right
    nodes, place = np.unique(np.concatenate([bits[left], bits[right]]), return_inverse=True)
    root = roots(len(nodes), place[: len(left)], place[len(left) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def linked(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) over the distinct ``bits`` of a table, enough to connect them."""
    if most < 2:
        raise ValueError("most must be at least 2")
    spark = prints.sparkSession
    masks = F.array(*[F.lit(m).cast("long") for m in variant_masks(most)])
    variants = prints.select("bits").distinct().select("bits", F.posexplode(masks).alias("variant", "mask"))
    keyed = variants.select(
        F.xxhash64("variant", F.col("bits").bitwiseAND(F.col("mask"))).alias("key"), "bits"
    )
    dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key")

    def run(batches):
        keys, bits, held = [], [], 0

        def joined(final: bool):
            nonlocal keys, bits, held
            k, b = np.concatenate(keys), np.concatenate(bits)
            # The last key may go on in the next batch.
            cut = len(k) if final else int(np.searchsorted(k, k[-1], "left"))
            a, c = forest(k[:cut], b[:cut].view(np.uint64), most)
            keys, bits, held = [k[cut:]], [b[cut:]], len(k) - cut
            return {"a": a.view(np.int64), "b": c.view(np.int64)}

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            bits.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > _ROWS:
                yield joined(False)
        if held:
            yield joined(True)

    return map_batches(dealt, run, "a long, b long")


def groups_of(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(bits, root): the group of every distinct fingerprint, one of its members."""
    tree = components(linked(prints, most)).withColumnRenamed("node", "bits")
    distinct = prints.select("bits").distinct()
    return distinct.join(tree, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    most: int = MOST_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    The component is the smallest doc_id reached; null if no member has one.
    """
    prints = staged(fingerprints(texts_of(docs, doc_id, text), shingle), "fingerprints")
    groups = staged(groups_of(prints, most), "groups")
    smallest = prints.groupBy("bits").agg(F.min("doc_id").alias("smallest"))
    least = (
        groups.join(smallest, "bits").groupBy("root").agg(F.min("smallest").alias("component_id"))
    )
    labels = groups.join(least, "root").select("bits", "component_id")
    return prints.join(labels, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(
    docs: DataFrame,
    shingle: int = SHINGLE,
    most: int = MOST_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns: of each group the row with the smallest doc_id.

    Among rows that share it, and in groups without any, a hash of the text
    decides. Rows alike in id and text are one row.
    """
    keyed = with_keys(docs, doc_id, text)
    prints = staged(fingerprints(keyed.select("one", "two", "doc_id", "text"), shingle), "fingerprints")
    groups = groups_of(prints, most)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "one", "two")
    first = prints.groupBy("bits").agg(F.min(order).alias("first"))
    chosen = first.join(groups, "bits").groupBy("root").agg(F.min("first").alias("first"))
    keys = chosen.select("first.one", "first.two").distinct()
    rows = keyed.select("one", "two", "row").join(keys, ["one", "two"], "left_semi")
    return rows.dropDuplicates(["one", "two"]).select("row.*")
