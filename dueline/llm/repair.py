"""Token ids in files compressed by Re-Pair grammars.

Texts are encoded in ascending doc_id order and their ids written in frames.
A frame is compressed by itself: again and again its most frequent pairs of
symbols are replaced by nonterminals, a batch of pairs of like counts per round,
until no pair stands ``LEAST_COUNT`` times. Pairs never cross the end of a document. A frame holds its rules,
the length each nonterminal expands to, where each document starts in ids and in
symbols, and the symbols; so one document, or a range of its ids, is decoded
without the others (``Frame.ids``).

Files are written under temporary names, moved to names that depend on the range
of doc_id alone, and listed in a manifest. Null texts count as empty and give the
end id alone; rows without a doc_id come first; repeated rows are kept each, in
the order of their texts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueline.llm._support import in_blocks, map_batches, partitions, texts_of
from dueline.llm.files import MANIFEST, RollingFiles, checked_files, file_name, new_folder, read_manifest
from dueline.llm.words import in_parts, library_table

FRAME_TOKENS = 1_000_000
ROLL_BYTES = 16 << 20
PAIRS_A_ROUND = 128
#: Pairs with this share of the last one's count are replaced in the same round.
ALIKE = 0.5
#: A pair has to save more symbols than its rule takes.
LEAST_COUNT = 16
_SLOTS = 18  # bits of the table in which pairs are counted before the exact count
_PIECE = 1 << 15
_HEAD = struct.Struct("<4sIIIIQ")  # name, terminals, rules, documents, symbols, bytes of the frame
_LEFT, _RIGHT, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(32 - _SLOTS)


def grammar(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, symbols and which symbols end a document, for ids that end at ``ends``."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[ends] = True

    def slots(at: np.ndarray) -> np.ndarray:
        """Slots of the pairs that begin at these places; document ends have one of their own."""
        after = symbols[np.minimum(at + 1, len(symbols) - 1)]
        found = (symbols[at] * _LEFT + after * _RIGHT) >> _SHIFT
        return np.where(last[at], 1 << _SLOTS, found).astype(np.intp)

    def places(full: np.ndarray) -> np.ndarray:
        """Where pairs of full slots begin, a piece that fits a cache at a time."""
        found = []
        for low in range(0, len(symbols) - 1, _PIECE):
            piece = symbols[low : low + _PIECE + 1]
            hit = full[(piece[:-1] * _LEFT + piece[1:] * _RIGHT) >> _SHIFT]
            hit &= ~last[low : low + len(hit)]
            found.append(np.flatnonzero(hit) + low)
        return np.concatenate(found) if found else np.zeros(0, np.intp)

    # Kept up to date where symbols change, not counted anew.
    counts = np.bincount(slots(np.arange(len(symbols))), minlength=(1 << _SLOTS) + 1)
    counts[-1] = 0
    rules: list[np.ndarray] = []
    count = 0
    while True:
        floor = np.partition(counts, -PAIRS_A_ROUND)[-PAIRS_A_ROUND]
        floor = max(LEAST_COUNT, int(ALIKE * floor))
        # Full slots may hold nothing but rare pairs; then all others are looked at.
        for floor in (floor, LEAST_COUNT):
            at = places(counts >= floor)
            pair = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
            order = np.argsort(pair)
            changes = np.concatenate([[True], np.diff(pair[order]) != 0]) if len(at) else np.zeros(0, bool)
            found = pair[order[changes]]
            exact = np.diff(np.append(np.flatnonzero(changes), len(at)))
            best = np.argsort(-exact, kind="stable")
            # Also those about as frequent as the last of them.
            low = [int(ALIKE * n) for n in exact[best[:PAIRS_A_ROUND][-1:]]]
            best = best[exact[best] >= max([LEAST_COUNT, *low])]
            if len(best) or floor == LEAST_COUNT:
                break
        if not len(best):
            break
        name = np.full(len(found), -1)
        name[best] = terminals + count + np.arange(len(best))
        new = np.empty(len(at), np.int64)
        new[order] = name[np.cumsum(changes) - 1]
        at, new = at[new >= 0], new[new >= 0]
        # Where chosen pairs overlap, every other one from the left is replaced.
        linked = np.concatenate([[False], np.diff(at) == 1])
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(linked, 0, place))
        keep = (place - begin) % 2 == 0
        at, new = at[keep], new[keep]
        # Pairs with a symbol that goes, and those around it, leave their slots.
        before = at[at > 0] - 1
        gone = at + 1
        kind = np.zeros(len(symbols), np.uint8)  # 1: stays and changes, 2: goes
        kind[at] = 1
        kind[before] = 1
        kind[gone] = 2
        around = np.flatnonzero(kind)
        counts -= np.bincount(slots(around), minlength=len(counts))
        symbols[at] = new
        last[at] = last[gone]
        stays = kind != 2
        symbols, last = symbols[stays], last[stays]
        changed = around[kind[around] == 1]
        changed -= np.searchsorted(gone, changed)
        counts += np.bincount(slots(changed), minlength=len(counts))
        counts[-1] = 0
        rules.append(np.stack([found[best] >> 32, found[best] & 0xFFFFFFFF], axis=1))
        count += len(best)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), symbols, last


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.int64)
    # Rules of one round only use symbols of earlier rounds, in ascending order.
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (1 if a < terminals else lengths[a - terminals]) + (
            1 if b < terminals else lengths[b - terminals]
        )
    return lengths


def frame(doc_ids: list[int | None], codes: list[bytes], terminals: int) -> bytes:
    """Bytes of a frame for documents given by their uint32 ids."""
    ids = np.frombuffer(b"".join(codes), "<u4")
    sizes = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rules, symbols, last = grammar(ids, starts[1:] - 1, terminals)
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1])
    width = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    parts = [
        rules.astype("<u4").tobytes(),
        expansion_lengths(rules, terminals).astype("<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u8").tobytes(),
        offsets.astype("<u4").tobytes(),
        symbols.astype(width).tobytes(),
    ]
    size = _HEAD.size + sum(map(len, parts))
    return _HEAD.pack(b"RPG1", terminals, len(rules), len(codes), len(symbols), size) + b"".join(parts)


class Frame:
    """Reader of one frame."""

    def __init__(self, data: bytes, at: int = 0):
        name, self.terminals, rules, docs, symbols, self.size = _HEAD.unpack_from(data, at)
        if name != b"RPG1":
            raise ValueError("not a frame of token ids")
        self._at = at + _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(data, kind, n, self._at)
            self._at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        ids, missing = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)]
        self.starts = take("<u8", docs + 1)
        self.offsets = take("<u4", docs + 1)
        self.symbols = take("<u2" if self.terminals + rules <= 1 << 16 else "<u4", symbols)
        # Expansions of all rules, one after the other, behind the terminals.
        first = self.terminals + np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self._first = np.concatenate([np.arange(self.terminals), first[:-1]])
        self._length = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        flat = np.empty(first[-1], "<u4")
        flat[: self.terminals] = np.arange(self.terminals)
        for k, (a, b) in enumerate(self.rules.tolist()):
            to, n = first[k], self._length[a]
            flat[to : to + n] = flat[self._first[a] : self._first[a] + n]
            flat[to + n : first[k + 1]] = flat[self._first[b] : self._first[b] + self._length[b]]
        self._flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self._length[symbols]
        ends = np.cumsum(lengths)
        shift = np.repeat(self._first[symbols] - (ends - lengths), lengths)
        return self._flat[shift + np.arange(len(shift))]

    def ids(self, doc: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids of the ``doc``-th document, or a range of them."""
        symbols = self.symbols[self.offsets[doc] : self.offsets[doc + 1]]
        ends = np.cumsum(self._length[symbols])
        total = int(ends[-1])
        stop = total if length is None else min(total, start + length)
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[start - skipped : stop - skipped]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)


def frames(data: bytes):
    at = 0
    while at < len(data):
        found = Frame(data, at)
        yield found
        at += found.size


def write_ids(
    docs: DataFrame,
    folder: str,
    path: str,
    pattern: str,
    end_id: int,
    terminals: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode and write all documents below ``folder``; returns the manifest."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = texts_of(docs, doc_id, text)
    ordered = (
        in_blocks(rows, "doc_id", parts)
        .repartitionById(parts, "_block")
        .sortWithinPartitions("_block", "doc_id", "text")
    )

    def run(batches):
        table = library_table(path, pattern, space_counts=True, added=True)
        end = np.array([end_id], "<u4").tobytes()
        files, current, ids, codes, tokens = None, None, [], [], 0

        def flush():
            nonlocal ids, codes, tokens
            if codes:
                files.add(frame(ids, codes, terminals), len(ids), tokens)
            ids, codes, tokens = [], [], 0

        for batch in batches:
            doc_ids, texts, blocks = (c.to_pylist() for c in batch.columns)
            for part in in_parts(texts):
                done = table.codes(texts[part])
                for i, code, block in zip(doc_ids[part], done, blocks[part], strict=True):
                    if block != current:
                        if files:
                            flush()
                            yield from files.finish()
                        files, current = RollingFiles(folder, block, ".rpg", ROLL_BYTES), block
                    ids.append(i)
                    codes.append(code.tobytes() + end)
                    tokens += len(code) + 1
                    if tokens >= FRAME_TOKENS:
                        flush()
        if files:
            flush()
            yield from files.finish()

    map_batches(ordered, run, MANIFEST, words=path).write.parquet(f"{folder.rstrip('/')}/_manifest")
    return read_manifest(spark, folder)


def first_ids(manifest: DataFrame) -> DataFrame:
    """(file, base): ids in all files before each, by block and then by file."""
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block, so this window does not grow with the documents.
    blocks = manifest.groupBy("block").agg(F.sum("units").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("below"))
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = manifest.withColumn("_own", F.coalesce(F.sum("units").over(inside), F.lit(0)))
    return own.join(blocks, "block").select("file", (F.col("below") + F.col("_own")).alias("base"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
    found = checked_files(spark, folder, ".rpg")
    if found is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for f in frames(content.as_py()):
                    raw = memoryview(f.all_ids().astype("<u4").tobytes())
                    starts = f.starts.astype(np.int64)
                    cuts = starts.tolist()
                    yield {
                        "file": [name] * len(f.doc_ids),
                        "doc_id": f.doc_ids,
                        "at": starts[:-1] + before,
                        "n_tokens": np.diff(starts),
                        "ids_crc32": [
                            zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                        ],
                    }
                    before += cuts[-1]

    rows = map_batches(found.select(file_name().alias("file"), "content"), run, schema)
    bases = first_ids(read_manifest(spark, folder))
    return rows.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def written_and_read(
    docs: DataFrame, path: str, pattern: str, end_id: int = 2, terminals: int = 50257
) -> DataFrame:
    """Documents encoded, written to new files in the shared folder and read back."""
    folder = new_folder(docs.sparkSession, "ids")
    write_ids(docs, folder, path, pattern, end_id, terminals)
    return read_ids(docs.sparkSession, folder)
