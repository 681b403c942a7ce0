"""Hierarchical packing of documents into sequences of several lengths.

Each partition of the documents is packed by itself, in one pass and without a
shuffle, so every id is encoded once and goes nowhere:

* A document's ids are cut into full windows of the longest tier; the rest is
  routed to the shortest tier that holds it.
* Each tier is packed into sequences of its own length, the longest tier first.
  A sequence opens with the longest rest of its tier; the gap is filled with the
  longest waiting rest that fits, of this tier or a shorter one. If none fits,
  it takes the first part of the shortest rest that is longer than the gap, and
  what remains of that is routed anew.
* When less than a sequence of a tier is waiting in all, it goes to the shorter
  tiers; less than one of the shortest is laid end to end and cut at powers of
  two. So no sequence needs padding.
* Sequences of one block and length are dealt to step groups of about
  ``STEP_TOKENS`` tokens, costliest first and back and forth, so the steps of a
  group cost about the same; the cost of a sequence is the sum of the squares of
  its pieces, as attention stays inside a piece.

A worker holds the ids of one block, ``BLOCK_TOKENS`` and a document at most.
Null texts count as empty and give the end id alone. Repeated rows are packed
each. Numbers of sequences hold the partition in their upper bits, so a rerun
task numbers them as before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dueline.llm._support import map_batches, texts_of
from dueline.llm.words import WORD_PATTERN, in_parts, library_table

WINDOW = 2048
TIERS = (128, 256, 512, 1024, 2048)
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 16 * WINDOW
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


class Rests:
    """Waiting rests by length: (document, start, length)."""

    def __init__(self) -> None:
        self.lengths: list[int] = []  # sorted, those with at least one rest
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.total = 0  # ids

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.of:
            self.of[length] = []
            insort(self.lengths, length)
        self.of[length].append((doc, start))
        self.total += length

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.of[length].pop()
        if not self.of[length]:
            del self.of[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.total -= length
        return doc, start, length

    def longest(self, most: int) -> int:
        """Greatest waiting length of at most ``most``, else 0."""
        i = bisect_left(self.lengths, most + 1)
        return self.lengths[i - 1] if i else 0

    def shortest_over(self, least: int) -> int:
        """Smallest waiting length above ``least``; there must be one."""
        return self.lengths[bisect_left(self.lengths, least + 1)]


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    return next(t for t in tiers if length <= t)


def pack(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list]:
    """Sequences of pieces (document, start, length) for documents of a block.

    Every sequence is as long as a tier, but for a last few whose lengths are
    powers of two. The longest tier is ``window``.
    """
    out, rests = [], Rests()
    for doc, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            out.append([(doc, start, window)])
        if n % window:
            rests.add(doc, n - n % window, n % window)
    sizes = [0, *sorted(t for t in tiers if t < window), window]
    for below, tier in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        while rests.total >= tier and rests.lengths[-1] > below:
            out.append(_filled(rests, tier))
    out += _powers_of_two(rests)
    return out


def _filled(rests: Rests, tier: int) -> list[tuple[int, int, int]]:
    """Pieces of one full sequence; at least ``tier`` ids must be waiting."""
    pieces, gap = [], tier
    while gap:
        if fits := rests.longest(gap):
            pieces.append(rests.take(fits))
            gap -= fits
        else:
            doc, start, n = rests.take(rests.shortest_over(gap))
            pieces.append((doc, start, gap))
            rests.add(doc, start + gap, n - gap)
            gap = 0
    return pieces


def _powers_of_two(rests: Rests) -> list[list]:
    left = [(d, s, n) for n in reversed(rests.lengths) for d, s in rests.of[n]]
    total, out = sum(n for _, _, n in left), []
    left.reverse()
    while total:
        gap = 1 << (total.bit_length() - 1)
        total -= gap
        pieces = []
        while gap:
            doc, start, n = left.pop()
            pieces.append((doc, start, min(n, gap)))
            if n > gap:
                left.append((doc, start + gap, n - gap))
            gap -= pieces[-1][2]
        out.append(pieces)
    return out


def step_groups(sequences: list[list], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int]]:
    """(tier, group) of each sequence: groups of one tier, alike in cost."""
    sizes = [sum(n for _, _, n in s) for s in sequences]
    costs = [sum(n * n for _, _, n in s) for s in sequences]
    out: list[tuple[int, int]] = [(0, 0)] * len(sequences)
    base = 0
    tier_by = [tier_of(n, tiers) for n in sizes]
    for tier in sorted(set(tier_by)):
        mine = [i for i, t in enumerate(tier_by) if t == tier]
        groups = -(-len(mine) * tier // STEP_TOKENS)
        for k, i in enumerate(sorted(mine, key=lambda i: -costs[i])):
            turn, place = divmod(k, groups)
            out[i] = (tier, base + (groups - 1 - place if turn % 2 else place))
        base += groups
    return out


def packed(
    docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents, encoded by a tokenizer file and packed.

    An empty table gives no rows.
    """

    def run(batches):
        table = library_table(path, WORD_PATTERN, space_counts=False, added=True)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        ids, codes, tokens, sequences, groups = [], [], 0, 0, 0

        def flush():
            nonlocal sequences, groups
            got = pack([len(c) // 4 for c in codes])
            steps = step_groups(got)
            columns = {name.split()[0]: [] for name in SCHEMA.split(", ")}
            add = [columns[n].append for n in columns]
            for s, (pieces, (tier, group)) in enumerate(zip(got, steps, strict=True)):
                offset = 0
                for doc, start, n in pieces:
                    code = codes[doc]
                    row = (
                        ids[doc],
                        start,
                        n,
                        zlib.crc32(memoryview(code)[4 * start : 4 * (start + n)]),
                        len(code) // 4,
                        first + sequences + s,
                        offset,
                        tier,
                        first + groups + group,
                    )
                    for put, value in zip(add, row, strict=True):
                        put(value)
                    offset += n
            sequences += len(got)
            groups += max((g for _, g in steps), default=-1) + 1
            return columns

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in in_parts(texts):
                for i, code in zip(doc_ids[part], table.codes(texts[part]), strict=True):
                    ids.append(i)
                    codes.append(code.tobytes() + end)
                    tokens += len(codes[-1]) // 4
                    if tokens > BLOCK_TOKENS:
                        yield flush()
                        ids, codes, tokens = [], [], 0
        if codes:
            yield flush()

    return map_batches(texts_of(docs, doc_id, text), run, SCHEMA, words=path)
