"""Removal of repeated byte strings by distributed suffix sorting.

Every string of ``width`` bytes belongs to the 24-byte string in it whose hash is
smallest, its anchor. Consecutive strings with one anchor form a segment, so
equal strings lie in segments of equal anchors wherever they stand. Segments are
shuffled by the anchor's hash and sorted there, group by group of equal anchors,
as ``suffixes`` describes; only groups with more than one segment are sorted.

* Equal segments of a block of documents are one segment of the shuffle. Their
  strings are known to be repeated, so only one copy travels, without places: a
  passage that a third of all documents share is shuffled once per block.
* A group of more than ``HOT_BYTES``, such as the contexts of a line that very
  many documents share, is not sorted by the task that finds it: it streams out
  and is dealt again by more of its bytes, half of what the key lacks of the
  string in each round, until groups are small or the key is the whole string.
* A bucket gets compressed pieces of about ``BUCKET_BYTES`` in total; the number
  of buckets follows the bytes of the corpus.
* Repeated runs travel back to their documents by two 64-bit hashes of id and
  text, so rows that agree in both share their runs.

Texts are judged as UTF-8 and as they came. Null texts count as empty; texts
shorter than ``width`` have no strings. Rows with equal ids are judged each by
its own text, a null id is an id like others, repeated rows repeat their whole
text, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import bounded_batches, lean, map_batches, partitions, staged, with_keys
from dueline.llm.suffixes import repeated_starts

WIDTH = 200
ANCHOR = 24
#: Bytes of segments in a bucket, and of documents that are cut at once.
BUCKET_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
CUT_BYTES = 1 << 19
#: Bytes of segments whose suffixes are sorted together.
SORT_BYTES = 1 << 19
#: Bytes of the segments of one key up to which they are sorted where they meet.
HOT_BYTES = 32 << 20
#: Segments take about this many times the bytes of their texts.
_SPREAD = 3.3
_PLACE_BITS = 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def anchor_hashes(data: bytes) -> np.ndarray:
    """Hash of the 24 bytes at every position; ``data`` has 24 bytes to spare."""
    n = len(data) - ANCHOR
    words = np.ndarray((n + ANCHOR - 7,), "<u8", data, strides=(1,)).copy()
    h = words[:n] * _A
    h ^= h >> np.uint64(31)
    h += words[8 : n + 8]
    h *= _B
    h ^= h >> np.uint64(29)
    h += words[16 : n + 16]
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position on."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def widenings(width: int) -> list[int]:
    """Bytes by which the key of a string grows in each round, from its anchor on."""
    out, rest = [], width - ANCHOR
    while rest:
        out.append(max(1, rest // 2))
        rest -= out[-1]
    return out


def key_spans(at: np.ndarray, anchor: np.ndarray, width: int, rounds: int):
    """Where the keys of strings at ``at`` begin and end after ``rounds`` widenings.

    A key grows to the left while the string reaches that far, else to the right,
    so equal strings have equal keys, and neighbours that grow alike share one.
    """
    low, high = anchor.copy(), anchor + ANCHOR
    for more in widenings(width)[:rounds]:
        left = low - at >= more
        low = np.where(left, low - more, low)
        high = np.where(left, high, high + more)
    return low, high


def segments(data: bytes, starts: np.ndarray, lengths: np.ndarray, width: int = WIDTH, rounds: int = 0):
    """Segments of texts that lie one after the other in ``data``.

    Gives the text, first byte and byte count of each, its key, and whether its
    anchor stands in it more than once. The key is the anchor's hash, or after
    ``rounds`` the hash of the bytes of ``key_spans``. ``data`` has bytes to spare.
    """
    span = width - ANCHOR + 1
    h = anchor_hashes(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = window_minimum((h & ~low) | (place & low), span)
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(len(owner)) + np.repeat(starts - (ends - counts), counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.astype(bool)
    chosen = least[at]
    # The anchor is the place within this window that the low bits name.
    anchor = at + ((chosen - at.astype(np.uint64)) & low).astype(np.int64)
    if rounds:
        key_low, key_high = key_spans(at, anchor, width, rounds)
        border = np.ones(len(at), bool)
        border[1:] = (key_low[1:] != key_low[:-1]) | (key_high[1:] != key_high[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(border)
        stop = np.append(first[1:], len(at))
        spans = zip(key_low[first].tolist(), key_high[first].tolist(), strict=True)
        keys = np.array([xxhash.xxh64_intdigest(data[a:b], rounds) for a, b in spans], np.uint64)
        # One key span a segment: no string of it can repeat inside it.
        return owner[first], at[first], at[stop - 1] + width - at[first], keys, np.zeros(len(first), bool)
    full = h[anchor]
    border = np.ones(len(at), bool)
    border[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(border)
    stop = np.append(first[1:], len(at))
    moved = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
    again = moved[stop - 1] > moved[first]
    wraps = (at[first] >> _PLACE_BITS) != ((at[stop - 1] + width) >> _PLACE_BITS)
    return owner[first], at[first], at[stop - 1] + width - at[first], full[first], again | wraps


class Blob:
    """Segments and known runs for one bucket, compressed."""

    head = struct.Struct("<III")

    @staticmethod
    def pack(hashes, lengths, kinds, keys, places, bytes_of, known) -> bytes:
        parts = [
            Blob.head.pack(len(hashes), len(bytes_of), len(known)),
            np.asarray(hashes, "<u8").tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            np.asarray(kinds, "u1").tobytes(),
            np.asarray(keys, "<i8").tobytes(),
            np.asarray(places, "<u4").tobytes(),
            np.asarray(known, "<i8").tobytes(),
            bytes_of,
        ]
        return zstandard.ZstdCompressor(level=5).compress(b"".join(parts))

    def __init__(self, packed: bytes):
        data = zstandard.ZstdDecompressor().decompress(packed)
        n, size, known = self.head.unpack_from(data)
        self._at = self.head.size

        def take(kind: str, count: int) -> np.ndarray:
            out = np.frombuffer(data, kind, count, self._at)
            self._at += out.nbytes
            return out

        self.hashes, self.lengths, self.kinds = take("<u8", n), take("<u4", n), take("u1", n)
        self.keys = take("<i8", 2 * n).reshape(-1, 2)
        self.places = take("<u4", n)
        self.known = take("<i8", 4 * known).reshape(-1, 4)
        self.bytes_of = data[self._at : self._at + size]

    def pieces(self) -> list[bytes]:
        ends = np.cumsum(self.lengths, dtype=np.int64).tolist()
        return [self.bytes_of[e - n : e] for e, n in zip(ends, self.lengths.tolist(), strict=True)]

    def without(self, hot: np.ndarray) -> bytes | None:
        """Take the segments of the keys ``hot`` out and give them, packed."""
        gone = np.isin(self.hashes, hot)
        if not gone.any():
            return None
        pieces = self.pieces()

        def part(rows):
            return (
                self.hashes[rows], self.lengths[rows], self.kinds[rows], self.keys[rows], self.places[rows],
                b"".join([pieces[i] for i in np.flatnonzero(rows)]),
            )

        packed = Blob.pack(*part(gone), ())
        self.hashes, self.lengths, self.kinds, self.keys, self.places, self.bytes_of = part(~gone)
        return packed


#: Kinds of segments: seen once in its block, or more often.
_ONCE, _OFTEN, _AGAIN = 0, 1, 2


def _block_blobs(found: dict, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of a block: ``found`` maps (hash, bytes) to a kind and places."""
    rows: dict[int, list] = {}
    known: dict[int, list] = {}
    for (h, piece), (kind, places) in found.items():
        more = kind & _AGAIN
        if len(places) == 1 and not kind & _OFTEN:
            one, two, start = places[0]
            row = (h, len(piece), _ONCE | more, one, two, start, piece)
        else:
            row = (h, len(piece), _OFTEN | more, 0, 0, 0, piece)
            for one, two, start in places:
                # Runs that are known already go along in a bucket of their document.
                known.setdefault(one % buckets, []).append((one, two, start, start + len(piece)))
        bucket = h % buckets
        if bucket in rows:
            rows[bucket].append(row)
        else:
            rows[bucket] = [row]
    for bucket in sorted({*rows, *known}):
        columns = list(zip(*rows.get(bucket, ()), strict=True)) or [()] * 7
        hashes, lengths, kinds, one, two, places, pieces = columns
        keys = np.stack([np.array(one, np.int64), np.array(two, np.int64)], axis=1)
        runs = known.get(bucket, ())
        yield bucket, Blob.pack(hashes, lengths, kinds, keys, places, b"".join(pieces), runs)


def _dealt_blobs(found: dict, buckets: int) -> Iterator[dict]:
    rows = list(_block_blobs(found, buckets))
    found.clear()
    for i in range(0, len(rows), 64):
        numbers, packed = zip(*rows[i : i + 64], strict=True)
        yield {"bucket": list(numbers), "blob": list(packed)}


def _cut(batches, width: int, buckets: int) -> Iterator[dict]:
    found: dict[tuple[int, bytes], tuple[int, list]] = {}
    held = 0

    def cut(group):
        raw = [g[2] for g in group]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        data = b"".join(raw) + bytes(width + ANCHOR + 8)
        columns = segments(data, starts, lengths, width)
        for owner, at, n, h, again in zip(*[c.tolist() for c in columns], strict=True):
            one, two, _ = group[owner]
            entry = found.setdefault((h, data[at : at + n]), (_AGAIN if again else 0, []))
            entry[1].append((one, two, at - int(starts[owner])))

    group, size = [], 0
    for batch in batches:
        for one, two, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) < width:
                continue
            group.append((one, two, raw))
            size += len(raw)
            if size > CUT_BYTES:
                cut(group)
                held += size
                group, size = [], 0
                if held > BLOCK_BYTES:
                    yield from _dealt_blobs(found, buckets)
                    held = 0
    if group:
        cut(group)
    yield from _dealt_blobs(found, buckets)


def _cut_again(batches, width: int, buckets: int, rounds: int) -> Iterator[dict]:
    """Segments of hot keys, cut and dealt by wider keys."""
    found: dict[tuple[int, bytes], list] = {}
    held = 0
    for batch in batches:
        for packed in batch.column(0):
            blob = Blob(packed.as_py())
            columns = zip(blob.pieces(), blob.kinds.tolist(), blob.keys.tolist(), blob.places.tolist(), strict=True)
            for piece, kind, (one, two), place in columns:
                # Slices share the bytes that a string over their border needs.
                for low in range(0, len(piece) - width + 1, CUT_BYTES):
                    raw = piece[low : low + CUT_BYTES + width - 1]
                    data = raw + bytes(width + ANCHOR + 8)
                    cut = segments(data, np.zeros(1, np.int64), np.array([len(raw)]), width, rounds)
                    for _, at, n, h, _ in zip(*[c.tolist() for c in cut], strict=True):
                        entry = found.setdefault((h, data[at : at + n]), [0, []])
                        held += n
                        if kind & _OFTEN:
                            entry[0] |= _OFTEN
                        else:
                            entry[1].append((one, two, place + low + at))
                if held > BLOCK_BYTES:
                    yield from _dealt_blobs(found, buckets)
                    held = 0
    yield from _dealt_blobs(found, buckets)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _sorted_runs(blobs: list[Blob], width: int) -> list[tuple[int, int, int, int]]:
    """Repeated runs (two keys, start, end) of the segments of one bucket."""
    out: list = []
    for b in blobs:
        out += map(tuple, b.known.tolist())
    hashes = np.concatenate([b.hashes for b in blobs])
    _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
    kinds = np.concatenate([b.kinds for b in blobs])
    todo = (count[group] > 1) | (kinds & _AGAIN > 0)
    # Equal segments become one; ``pieces`` has how often each was seen.
    pieces: dict[tuple[int, bytes], list] = {}
    i = 0
    for b in blobs:
        ends = np.cumsum(b.lengths, dtype=np.int64).tolist()
        lengths, places, keys = b.lengths.tolist(), b.places.tolist(), b.keys.tolist()
        for k in np.flatnonzero(todo[i : i + len(lengths)]).tolist():
            piece = b.bytes_of[ends[k] - lengths[k] : ends[k]]
            entry = pieces.setdefault((int(group[i + k]), piece), [0, []])
            often = bool(kinds[i + k] & _OFTEN)
            entry[0] += 2 if often else 1
            if not often:
                entry[1].append((*keys[k], places[k]))
        i += len(lengths)
    waiting: dict[int, list] = {}
    for (g, piece), (seen, spots) in pieces.items():
        if seen > 1:
            out += [(one, two, s, s + len(piece)) for one, two, s in spots]
        waiting.setdefault(g, []).append((piece, spots if seen == 1 else []))
    part, size = [], 0
    for same in waiting.values():
        part += same
        size += sum(len(p) for p, _ in same)
        if size > SORT_BYTES:
            out += _sort_part(part, width)
            part, size = [], 0
    return out + _sort_part(part, width)


def _sort_part(part: list[tuple[bytes, list]], width: int) -> list[tuple[int, int, int, int]]:
    if not part:
        return []
    lengths = np.fromiter((len(p) for p, _ in part), np.int64, len(part))
    starts = np.cumsum(lengths) - lengths
    flags = repeated_starts(b"".join(p for p, _ in part), starts, lengths, width)
    out = []
    for (_, spots), start, n in zip(part, starts.tolist(), lengths.tolist(), strict=True):
        if spots and flags[start : start + n].any():
            for a, b in zip(*_runs(flags[start : start + n]), strict=True):
                out += [(one, two, s + int(a), s + int(b) - 1 + width) for one, two, s in spots]
    return out


def _hot(blobs: list[Blob], most: int) -> np.ndarray:
    """Keys with segments of more than ``most`` bytes."""
    keys, group = np.unique(np.concatenate([b.hashes for b in blobs]), return_inverse=True)
    sizes = np.bincount(group, np.concatenate([b.lengths for b in blobs]), len(keys))
    return keys[sizes > most]


def _sort_buckets(batches, width: int, most: int | None) -> Iterator[dict]:
    """Repeated runs of every bucket; segments of keys above ``most`` bytes as blobs."""

    def runs(blobs):
        found = _sorted_runs(blobs, width)
        if found:
            one, two, start, end = zip(*found, strict=True)
            none = [None] * len(one)
            yield {"one": list(one), "two": list(two), "start": list(start), "end": list(end), "blob": none}

    def given(blobs, hot):
        for b in blobs:
            if packed := b.without(hot):
                yield {"one": [None], "two": [None], "start": [None], "end": [None], "blob": [packed]}

    def sifted(held, hot):
        """Give what is found hot; whether a key is hot follows from all its bytes."""
        new = _hot(held, most)
        if len(new):
            yield from given(held, new)
            hot[0] = np.concatenate([hot[0], new])

    def closed(held, size, hot):
        if most is not None and size > most:
            yield from sifted(held, hot)
        if held:
            yield from runs(held)

    current, held, size, check, hot = None, [], 0, 0, [np.zeros(0, np.uint64)]
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != current:
                yield from closed(held, size, hot)
                current, held, size, check, hot = bucket, [], 0, most, [np.zeros(0, np.uint64)]
            blob = Blob(packed.as_py())
            if len(hot[0]):
                yield from given([blob], hot[0])
            held.append(blob)
            size += len(blob.bytes_of)
            if most is not None and size > check:
                yield from sifted(held, hot)
                size = sum(len(b.bytes_of) for b in held)
                check = size + most
    yield from closed(held, size, hot)


def _without(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw``, and the number of maximal runs taken out."""
    kept, at, spans, reach = [], 0, 0, -1
    for start, end in sorted(runs):
        if start > reach:
            spans += 1
        if start > at:
            kept.append(raw[at:start])
        at = max(at, end)
        reach = max(reach, end)
    kept.append(raw[at:])
    return b"".join(kept), spans


def repeated_runs(rows: DataFrame, width: int = WIDTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(one, two, runs) of the texts of ``with_keys`` that have repeated strings."""
    if (width - 2) % 3 or width < 98:
        raise ValueError("width must be 2 more than a multiple of 3 and at least 98")
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(total * _SPREAD / BUCKET_BYTES))
    blobs = map_batches(
        rows.select("one", "two", "text"), partial(_cut, width=width, buckets=buckets), "bucket int, blob binary"
    )
    last, found = len(widenings(width)), None
    for rounds in range(last + 1):
        parts = min(partitions(spark), buckets)
        dealt = blobs.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
        sort = partial(_sort_buckets, width=width, most=hot_bytes if rounds < last else None)
        done = staged(map_batches(dealt, sort, "one long, two long, start int, end int, blob binary"), "runs")
        runs = done.filter(F.col("blob").isNull()).drop("blob")
        found = runs if found is None else found.unionByName(runs)
        hot = done.filter(F.col("blob").isNotNull()).select("blob")
        size = hot.agg(F.sum(F.octet_length("blob"))).first()[0]
        if not size:
            break
        # Blobs are compressed to about an eighth, and cut again they overlap.
        buckets = max(1, int(size * 8 * _SPREAD / BUCKET_BYTES))
        again = partial(_cut_again, width=width, buckets=buckets, rounds=rounds + 1)
        blobs = map_batches(hot.repartition(partitions(spark)), again, "bucket int, blob binary")
    return found.groupBy("one", "two").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def without_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """(doc_id, text, kept, n_removed, n_spans): kept is the text's other bytes."""
    rows = with_keys(docs, doc_id, text).drop("row")
    joined = rows.join(repeated_runs(rows, width, hot_bytes), ["one", "two"], "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            doc_ids, texts, runs = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            done = [
                _without(r, [(x["start"], x["end"]) for x in found or ()])
                for r, found in zip(raw, runs.to_pylist(), strict=True)
            ]
            yield {
                "doc_id": doc_ids,
                "n_bytes": [len(r) for r in raw],
                "n_removed": [len(r) - len(k) for r, (k, _) in zip(raw, done, strict=True)],
                "n_spans": [n for _, n in done],
                "kept": [k for k, _ in done],
            }

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, width: int = WIDTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Counts and the digest of what is kept of every document."""
    return without_repeats(docs, width, hot_bytes=hot_bytes).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def cleaned(
    docs: DataFrame,
    width: int = WIDTH,
    doc_id: str = "doc_id",
    text: str = "text",
    n_chars: str = "n_chars",
) -> DataFrame:
    """Rows of ``docs``, all columns, with their repeats taken out of the text.

    Bytes of a character that was cut go too, and ``n_chars`` follows the text.
    Rows that nothing is left of are dropped; rows without repeats stay as they
    are.
    """
    keyed = with_keys(docs, doc_id, text)
    runs = repeated_runs(keyed.drop("row"), width)
    joined = keyed.select("one", "two", "row").join(runs, ["one", "two"], "left").select("row", "runs")
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at, count = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches):
        lean()
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, found = columns[at].to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, hit in enumerate(found):
                if hit:
                    kept, _ = _without(texts[i].encode("utf-8", "surrogatepass"), [(x["start"], x["end"]) for x in hit])
                    texts[i] = kept.decode("utf-8", "ignore")
                keep.append(not hit or bool(texts[i]))
            if count is not None:
                lengths = columns[count].to_pylist()
                lengths = [len(t) if hit else n for t, n, hit in zip(texts, lengths, found, strict=True)]
                columns[count] = pa.array(lengths, columns[count].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
