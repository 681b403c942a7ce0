"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

A text is the multiset of its lines. Each paragraph is hashed to a wide vector,
and the fingerprint is the sum of these vectors, so the order of paragraphs does
not matter and a paragraph is inserted or deleted by adding or subtracting its
vector (``plus``, ``minus``). A vector has two parts:

* 32 lanes modulo 2**32 from SHAKE-128 of the whole paragraph, for equality;
* 512 lanes modulo 2**32: each window of 16 bytes of the paragraph adds 1 or -1
  to one lane. Read as signed numbers, inner products of such sums estimate how
  many windows two texts share, which gives ``likeness``. A text below 2 GiB has
  too few windows for a lane to go around.

Both parts are functions of the paragraph alone. Null texts count as empty; an
empty text is one empty paragraph. Equal multisets have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import in_blocks, map_batches, partitions, texts_of

EXACT_LANES = 32
LIKE_LANES = 512
WINDOW = 16
#: Characters hashed at once, which bounds the arrays of a worker.
CHUNK_CHARS = 500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (uint32) and likeness lanes (int32) of texts, as they are stored."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [r.split(b"\n") for r in raw]
    digests = b"".join(
        hashlib.shake_128(p).digest(4 * EXACT_LANES) for parts in pieces for p in parts
    )
    per_text = np.fromiter(map(len, pieces), np.int64, n)
    hashed = np.frombuffer(digests, "<u4").reshape(-1, EXACT_LANES)
    starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    exact = np.add.reduceat(hashed, starts, axis=0, dtype=np.uint32)

    lanes = 2 * LIKE_LANES
    data = b"\n".join(raw) + b"\n" + bytes(WINDOW)
    size = len(data) - WINDOW
    bytes_of = np.frombuffer(data, np.uint8)[:size]
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, n)
    owner = np.repeat(np.arange(n, dtype=np.int64), lengths)
    breaks = np.concatenate([[0], np.cumsum(bytes_of == 10, dtype=np.int32)])
    whole = np.zeros(size, bool)
    if size >= WINDOW:
        whole[: size - WINDOW + 1] = breaks[WINDOW:] == breaks[:-WINDOW]
    at = np.flatnonzero(whole)
    words = np.ndarray((size,), "<u8", data, strides=(1,)).copy()
    h = words[at] * _A
    h ^= h >> np.uint64(31)
    h += words[at + 8] * _B
    h ^= h >> np.uint64(29)
    h *= _C
    slot = owner[at] * lanes + (h >> np.uint64(54)).astype(np.int64)
    counts = np.bincount(slot, minlength=n * lanes)
    # A paragraph shorter than a window is one piece of its own.
    ends = np.flatnonzero(bytes_of == 10)
    long = np.diff(np.concatenate([[-1], ends])) - 1
    short = (long > 0) & (long < WINDOW)
    counts += np.bincount(
        owner[ends[short]] * lanes + (hashed[short, 0] >> np.uint32(22)).astype(np.int64),
        minlength=n * lanes,
    )
    counts = counts.reshape(n, LIKE_LANES, 2)
    return exact, (counts[:, :, 0] - counts[:, :, 1]).astype(np.uint32).view(np.int32)


def as_text(exact: np.ndarray, like: np.ndarray) -> list[str]:
    return [
        a.astype("<u4").tobytes().hex() + b.astype("<i4").tobytes().hex()
        for a, b in zip(exact, like, strict=True)
    ]


def _lanes(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * EXACT_LANES], "<u4"), np.frombuffer(raw[4 * EXACT_LANES :], "<u4")


def of_text(text: str | None) -> str:
    return as_text(*vectors([text or ""]))[0]


def plus(a: str, b: str) -> str:
    """Fingerprint of the paragraphs of both."""
    (x, y), (u, v) = _lanes(a), _lanes(b)
    return (x + u).tobytes().hex() + (y + v).tobytes().hex()


def minus(a: str, b: str) -> str:
    """Fingerprint of ``a`` after its paragraphs in ``b`` are deleted."""
    (x, y), (u, v) = _lanes(a), _lanes(b)
    return (x - u).tobytes().hex() + (y - v).tobytes().hex()


def likenesses(a: tuple, b: tuple) -> np.ndarray:
    """Estimated cosine of the two multisets of windows, 0 to 1; 1 if equal."""
    (exact_a, like_a), (exact_b, like_b) = a, b
    x, y = like_a.astype(np.float64), like_b.astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    dot = (x * y).sum(1)
    out = np.clip(np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), 0.0, 1.0)
    equal = (exact_a == exact_b).all(1) & (like_a == like_b).all(1)
    return np.where(equal, 1.0, out)


def likeness(a: str, b: str) -> float:
    one, two = _lanes(a), _lanes(b)
    signed = [(e[None], v.view("<i4")[None]) for e, v in (one, two)]
    return float(likenesses(*signed)[0])


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text, without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for part in _chunks(texts):
                out += as_text(*vectors(part))
            yield {"doc_id": batch.column(0), "fingerprint": out}

    return map_batches(texts_of(docs, doc_id, text), run, "doc_id long, fingerprint string")


def _chunks(texts: list[str]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_successor(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in blocks of descending doc_id, each block ended by its successor.

    Blocks are ranges of doc_id and one partition each, sorted. The first row of
    a block is copied to the end of the block before it (``_copy`` = 1), that of
    the first block to the end of the last. Ties of doc_id go by text, null ids
    are last. Of a block's copies only the first is a successor.
    """
    rows = texts_of(docs, doc_id, text)
    spark = docs.sparkSession
    parts = partitions(spark)
    blocks = in_blocks(rows, "doc_id", parts).withColumn("_block", -F.col("_block"))
    # One row per block comes to the driver: its number and its largest id.
    heads = sorted(
        (r["_block"], r["head"])
        for r in blocks.groupBy("_block").agg(F.max("doc_id").alias("head")).collect()
    )
    targets = [
        (block, head, heads[i - 1][0]) for i, (block, head) in enumerate(heads)
    ]
    # At most one row per block, so its size is known.
    small = spark.createDataFrame(targets, "_of int, _head long, _to int")
    joined = blocks.join(F.broadcast(small), F.col("_block") == F.col("_of"))
    own = F.struct(F.col("_block").alias("block"), F.lit(0).alias("copy"))
    also = F.struct(F.col("_to").alias("block"), F.lit(1).alias("copy"))
    first = F.col("doc_id").eqNullSafe(F.col("_head"))
    placed = joined.select(
        "doc_id", "text", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))).alias("p")
    ).select("doc_id", "text", F.col("p.block").alias("_block"), F.col("p.copy").alias("_copy"))
    return placed.repartitionById(parts, -F.col("_block")).sortWithinPartitions(
        "_block", "_copy", F.desc_nulls_last("doc_id"), "text"
    )


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last third replaced by the start of the next
    document in descending doc_id. Columns as in the query; a text alone in its
    table is its own next document.
    """

    def run(batches):
        block, done, ids, texts, size = None, True, [], [], 0

        def flush():
            edited = []
            for t, after in zip(texts[:-1], texts[1:], strict=True):
                k = len(t) // 3
                edited.append(t[: len(t) - k] + after[:k])
            n = len(edited)
            exact, like = vectors(texts + edited)
            own, after, new = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
            return {
                "doc_id": ids[:n],
                "n_chars": [len(t) for t in texts[:n]],
                "edited_sha256": [
                    hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited
                ],
                "fingerprint": as_text(exact[own], like[own]),
                "edited_fingerprint": as_text(exact[new], like[new]),
                "near_edited": likenesses((exact[own], like[own]), (exact[new], like[new])),
                "near_next": likenesses((exact[own], like[own]), (exact[after], like[after])),
            }

        for batch in batches:
            for i, t, b, copy in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block:
                    block, done, ids, texts, size = b, False, [], [], 0
                if done:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                done = copy == 1
                if len(texts) > 1 and (done or size > CHUNK_CHARS):
                    yield flush()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return map_batches(
        with_successor(docs, doc_id, text),
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
