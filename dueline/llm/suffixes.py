"""Order of suffixes by a difference cover, compared up to a fixed width.

Two suffixes are equal here if their first ``width`` bytes are. Positions 1 and 2
modulo 3 are the sample: for any two positions there is a shift of at most two
bytes that brings both into it.

* The letters are 8-byte words, named by rank. Triples of them at sampled positions
  are sorted and named by rank.
* These names are the next text: its triples are sorted and named again, until a
  name covers ``width - 2`` bytes (24, 72, .. bytes).
* The suffixes left out are merged in by the byte or two before a sampled
  position: one order for the sample, one for positions 0 and 1 modulo 3 and one
  for 0 and 2, so that any two suffixes meet in one of the three orders.
* In each order, neighbours with an equal prefix are repeated.
"""

from __future__ import annotations

import numpy as np


def ranks(key: np.ndarray) -> np.ndarray:
    """Dense rank of each key."""
    order = np.argsort(key)
    in_order = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]]))
    return out


def triple_ranks(names: np.ndarray, at: np.ndarray, step: int, last: int) -> np.ndarray:
    """Dense rank of the triples of names at, ``step`` after and ``last`` after ``at``."""
    bits = int(names.max(initial=0)).bit_length()
    if 3 * bits <= 63:
        return ranks(names[at] << (2 * bits) | names[at + step] << bits | names[at + last])
    return ranks(ranks(names[at] << 32 | names[at + step]) << 32 | names[at + last])


def has_equal(key: np.ndarray) -> np.ndarray:
    """Which rows stand beside an equal one once sorted."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def sample_names(text: np.ndarray, size: int, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes at each sampled position below ``size``.

    ``text`` has zero bytes behind ``size``. Other positions hold 0.
    """
    raw = text.tobytes()
    words = np.ndarray((len(text) - 7,), ">u8", raw, strides=(1,)).astype(np.uint64)
    names = ranks(words)
    at = np.arange(size)
    at = at[at % 3 != 0]
    covered, step, last = 8, 8, 16
    while covered < width:
        found = triple_ranks(names, at, step, last)
        names = np.zeros(len(text), np.int64)
        names[at] = found
        covered += last
        # The last names overlap, so that they end where the prefix does.
        step, last = covered, min(2 * covered, width - covered)
        step = min(step, last // 2 // 3 * 3)
    return names


def repeated_starts(data: bytes, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Which positions begin a string of ``width`` bytes found elsewhere too.

    Strings lie inside the pieces of ``data`` given by ``starts`` and
    ``lengths``; ``width - 2`` is at least 24 and a multiple of 3.
    """
    size = len(data)
    text = np.frombuffer(data + bytes(width + 32), np.uint8)
    inside = np.zeros(size, bool)
    edges = np.zeros(size + 1, np.int64)
    counts = np.maximum(lengths - width + 1, 0)
    np.add.at(edges, starts, (counts > 0).astype(np.int64))
    np.add.at(edges, starts + counts, -(counts > 0).astype(np.int64))
    inside = np.cumsum(edges[:-1]) > 0
    names = sample_names(text, size + 2, width - 2)
    out = np.zeros(size, bool)
    low = text.astype(np.int64)
    for left_out, shift in ((0, 0), (2, 1), (1, 2)):
        at = np.flatnonzero(inside)
        at = at[at % 3 != left_out]
        if not len(at):
            continue
        key = names[at + shift] << 16
        # The two bytes that the name at this shift does not cover.
        before = [low[at + i] for i in range(shift)]
        behind = [low[at + width - 2 + shift + i] for i in range(2 - shift)]
        for i, b in enumerate([*before, *behind]):
            key |= b << (8 * (1 - i))
        out[at] |= has_equal(key)
    return out
