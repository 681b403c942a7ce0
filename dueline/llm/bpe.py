"""Byte-level BPE encoding and decoding by merge replay over a block's words.

A block of documents is a corpus: its distinct words are laid out as one array
of symbols, an inverted index maps the rank of each mergeable pair to the
positions where it stands, and merges are applied in rank order, all positions
of one rank at once. Only the neighbours of a merged pair are looked up again.
Documents need no shuffle, and memory follows the block, not the corpus.

Null texts count as empty and have no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from dueline.llm._support import map_batches, texts_of
from dueline.llm.words import WordTable, in_parts


class MergeReplay:
    """Encoder and decoder for a file of ranks and a split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        found = np.array(sorted(pairs), np.int64)
        self.pairs, self.merged = found[:, 0].copy(), found[:, 1].copy()
        self.table = WordTable(self._matches, pattern, space_counts=True)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, -1 if there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as uint32 bytes."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbol = self.of_byte[data]
        symbol[starts + lengths] = -1  # one border after each word
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = n - 1
        rank = np.full(n, -1)
        rank[:-1] = self._lookup(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        odd: list[np.ndarray] = []

        def add(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(
                ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True
            ):
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(part)

        first = np.flatnonzero(rank >= 0)
        if len(first):
            add(first, rank[first])
        while waiting:
            r = heapq.heappop(waiting)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                # Of pairs that overlap, every other one from the left is merged.
                linked = after[at[:-1]] == at[1:]
                if linked.any():
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(
                        np.where(np.concatenate([[True], ~linked]), place, 0)
                    )
                    at = at[(place - begin) % 2 == 0]
            second = after[at]
            third = after[second]
            symbol[at] = r
            symbol[second] = -2
            rank[second] = -1
            after[at] = third
            before[third] = at
            touched = np.concatenate([before[at], at])
            if len(at) > 1:
                touched = np.unique(touched)
            touched = touched[symbol[touched] >= 0]
            new = self._lookup(symbol[touched], symbol[after[touched]])
            rank[touched] = new
            some = new >= 0
            if some.any():
                touched, new = touched[some], new[some]
                if new.min() < r:
                    odd.append(touched[new < r])
                add(touched, new)
        alive = np.flatnonzero(symbol >= 0)
        bounds = [*(4 * np.searchsorted(alive, starts)).tolist(), 4 * len(alive)]
        ids = symbol[alive].astype("<u4").tobytes()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        # A merge of a lower rank came up late: such words are done one by one.
        for w in set(np.searchsorted(starts, np.concatenate(odd), "right") - 1) if odd else ():
            out[w] = np.array(self.alone(words[w]), "<u4").tobytes()
        return out

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word, always merging its lowest rank, leftmost first."""
        symbols = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(word) and (r := self.ranks.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        for i in range(len(word)):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(word) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, b""
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [self.ranks[s] for s in symbols if s]

    def _matches(self, matches: list[str]) -> list[bytes]:
        raw = [m.encode("utf-8", "surrogatepass") for m in matches]
        rest = [r for r in raw if r not in self.ranks]
        code = dict(zip(rest, self.replay(rest), strict=True))
        return [code[r] if r in code else self.ranks[r].to_bytes(4, "little") for r in raw]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.table.codes(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], MergeReplay] = {}


def loaded(path: str, pattern: str) -> MergeReplay:
    """One encoder per worker and file; ranks are read where they are used."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(path, pattern)
    return _LOADED[path, pattern]


def encoded(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in in_parts(texts):
                yield {"doc_id": ids[part.start : part.stop], "ids": bpe.encode(texts[part])}

    return map_batches(texts_of(docs, doc_id, text), run, "doc_id long, ids array<int>")


def round_trip(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digests of every text's ids and of the bytes these decode to."""

    def run(batches):
        bpe = loaded(path, pattern)
        decimal = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in in_parts(texts):
                counts, id_digests, digests = [], [], []
                for found in bpe.encode(texts[part]):
                    ids = found.tolist()
                    counts.append(len(ids))
                    joined = " ".join(map(decimal.__getitem__, ids))
                    id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    digests.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield {
                    "doc_id": doc_ids[part.start : part.stop],
                    "n_tokens": counts,
                    "ids_sha256": id_digests,
                    "decoded_sha256": digests,
                }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts_of(docs, doc_id, text), run, schema)
