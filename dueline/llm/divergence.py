"""How the sources of a language differ in their words: an audit in exact numbers.

Term counts come from single-pass in-memory indexing. A task keeps the postings of
a block of documents in memory; when the block has ``BLOCK_BYTES`` it spills them as
a run: sorted by (shard, language, term), each shard's part cut into segments of
``SEGMENT_TERMS``. The shard of a term is a hash of language and term. A shard's
task gets the segments of all runs in the order of their first terms and merges
them through a heap; a segment is opened when its first term is due, so what a
task holds is one open segment per run, however large the shard is. A term that
every document has is one posting per run and source.

Pairs of sources are compared over all kept terms of their language without going
through them pair by pair. Let ``p0`` be a source's share of a term that it has
not got. Every term is first taken as missing in both sources, then, from how
often each share occurs in a source, as missing in the other; these need the
histogram of a source alone, which has about the square root of its words as
entries at most. What is left are corrections for terms that both have. They are
streamed term by term, in parts of ``PAIRS`` pairs at most.

Null text, language and source count as ''. Repeated rows are documents each.
An empty table gives no rows. A language without kept terms has values of 0.
"""

from __future__ import annotations

import heapq
import marshal
import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dueline.llm._support import map_batches, partitions, staged

#: Bytes of the texts of a block, and terms of a segment at most.
BLOCK_BYTES = 8 << 20
SEGMENT_TERMS = 1000
#: Documents of a language that a kept term stands in, and ranks of a report of terms.
LEAST_DOCUMENTS = 3
RANKS = 200
SCALE = 1_000_000_000
#: Pairs of postings compared at once, rows taken for them, sources in a block, shares at once.
PAIRS = 1 << 20
CORRECTED_ROWS = 30_000
SOURCES = 256
SHARES = 4096
#: Bytes of terms: ASCII letters, lowered, and whatever is beyond ASCII.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Block:
    """Documents of a block, and the postings of their terms."""

    def __init__(self) -> None:
        self.documents: list[tuple[str, str, bytes]] = []
        self.bytes = 0

    def add(self, lang: str, source: str, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        self.documents.append((lang, source, data))
        self.bytes += len(data)

    def _words(self) -> tuple[pa.Array, np.ndarray]:
        """All terms in the order of the documents, and how many each document has."""
        sizes = np.fromiter((len(d[2]) for d in self.documents), np.int64, len(self.documents)) + 1
        joined = b" ".join([b"", *(d[2] for d in self.documents), b""])
        data = np.frombuffer(joined.translate(_LETTERS), np.uint8)
        letter = data != 32
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), buffers)
        starts = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]) + 1)
        return words, np.diff(starts)

    def run(self, shards: int) -> Iterator[tuple[int, str, bytes, bytes]]:
        """(shard, language, first term, segment) in the order of shard, language, term."""
        self.documents.sort(key=itemgetter(0, 1))
        words, many = self._words()
        if not len(words):
            return
        groups = sorted({d[:2] for d in self.documents})
        langs = sorted({g[0] for g in groups})
        number = {g: i for i, g in enumerate(groups)}
        group = np.array([number[d[:2]] for d in self.documents])
        tongue = np.array([langs.index(g[0]) for g in groups])
        # Terms by rank; then (term, document) pairs in order, which is that of groups too.
        coded = words.dictionary_encode()
        by_term = pc.array_sort_indices(coded.dictionary)
        vocabulary = coded.dictionary.take(by_term).to_pylist()
        rank = np.empty(len(vocabulary), np.int64)
        rank[by_term.to_numpy()] = np.arange(len(vocabulary))
        pair = rank[coded.indices.to_numpy()] * len(many) + np.repeat(np.arange(len(many)), many)
        pair, times = _runs(np.sort(pair))
        term, of_group = pair // len(many), group[pair % len(many)]
        # Postings (term, group) with their counts, entries (term, language) with their documents.
        starts = _starts(term * len(groups) + of_group)
        count = np.add.reduceat(times, starts)
        posted, posted_group = term[starts], of_group[starts]
        lang = tongue[of_group]
        entry = _starts(term * len(langs) + lang)
        documents = np.diff(np.append(entry, len(term)))
        first = _starts(posted * len(langs) + tongue[posted_group])
        size = np.diff(np.append(first, len(posted)))
        term, lang = term[entry], lang[entry]
        seeds = [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in langs]
        shard = np.array(
            [zlib.crc32(vocabulary[t], seeds[g]) % shards for t, g in zip(term.tolist(), lang.tolist(), strict=True)]
        )
        order = np.lexsort((term, lang, shard))
        shard, lang, term, documents, first, size = (
            x[order] for x in (shard, lang, term, documents, first, size)
        )
        ends = np.cumsum(size)
        moved = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
        count, source = count[moved], posted_group[moved]
        cuts = _starts(shard * len(langs) + lang).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(term)], strict=True):
            for low in range(a, z, SEGMENT_TERMS):
                high = min(low + SEGMENT_TERMS, z)
                inside = slice(int(ends[low] - size[low]), int(ends[high - 1]))
                here = [vocabulary[t] for t in term[low:high].tolist()]
                yield int(shard[low]), langs[lang[low]], here[0], marshal.dumps((
                    here, documents[low:high].tolist(), size[low:high].tolist(),
                    [groups[g][1] for g in source[inside].tolist()], count[inside].tolist(),
                ))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs and their lengths."""
    starts = _starts(ordered)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def entries(segment: bytes) -> Iterator[tuple[bytes, int, list, list]]:
    """(term, documents, sources, counts) of a segment."""
    terms, documents, sizes_, sources, counts = marshal.loads(segment)
    at = 0
    for term, n, size in zip(terms, documents, sizes_, strict=True):
        yield term, n, sources[at : at + size], counts[at : at + size]
        at += size


def merged(segments: Iterable[tuple[str, bytes, bytes]]) -> Iterator[tuple[str, tuple]]:
    """Entries of segments that come in the order of their first terms, merged by a heap."""
    heap: list = []
    coming = iter(segments)
    ahead, serial = next(coming, None), 0
    while heap or ahead is not None:
        if ahead is not None and (not heap or ahead[:2] <= (heap[0][0], heap[0][1])):
            rest = entries(ahead[2])
            entry = next(rest)
            heapq.heappush(heap, (ahead[0], entry[0], serial, entry, rest))
            ahead, serial = next(coming, None), serial + 1
            continue
        lang, _, mark, entry, rest = heap[0]
        yield lang, entry
        entry = next(rest, None)
        if entry is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (lang, entry[0], mark, entry, rest))


def frequencies(found: Iterable[tuple[str, tuple]]) -> Iterator[tuple[str, bytes, int, dict]]:
    """(language, term, documents, counts by source) from merged entries."""
    now = last = None
    documents, counts = 0, {}
    for lang, (term, n, sources, times) in found:
        if term != last or lang != now:
            if now is not None:
                yield now, last, documents, counts
            now, last, documents, counts = lang, term, 0, {}
        documents += n
        for source, k in zip(sources, times, strict=True):
            counts[source] = counts.get(source, 0) + k
    if now is not None:
        yield now, last, documents, counts


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, total, first): counts of terms in enough documents.

    ``docs`` has text, lang and source without nulls. ``total`` is the sum over the
    sources; ``first`` is 1 on one row of each term.
    """
    shards = partitions(docs.sparkSession)

    def index(batches):
        block = Block()

        def spilled():
            rows = list(zip(*block.run(shards), strict=True)) or [()] * 4
            return dict(zip(("shard", "lang", "term", "segment"), map(list, rows), strict=True))

        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(lang, source, text)
                if block.bytes >= BLOCK_BYTES:
                    yield spilled()
                    block = Block()
        if block.documents:
            yield spilled()

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def merge(batches):
        names = ("lang", "term", "source", "n", "total", "first")
        out: list[tuple] = []
        segments = rows(batches)
        ahead = next(segments, None)
        while ahead is not None:
            shard = ahead[0]

            def of_shard():
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    yield ahead[1:]
                    ahead = next(segments, None)

            for lang, term, documents, counts in frequencies(merged(of_shard())):
                if documents >= LEAST_DOCUMENTS:
                    total, first = sum(counts.values()), 1
                    word = term.decode("utf-8", "surrogatepass")
                    for source in sorted(counts):
                        out.append((lang, word, source, counts[source], total, first))
                        first = 0
                if len(out) > 20_000:
                    yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                    out = []
        if out:
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    runs = map_batches(
        docs.select("text", "lang", "source"), index, "shard int, lang string, term binary, segment binary"
    )
    dealt = runs.repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "term")
    return map_batches(
        dealt, merge, "lang string, term string, source string, n long, total long, first int"
    )


def share(count: str) -> str:
    """SQL for 1 + floor(10^9 (count + 1) / (words + kinds)), exact; null without terms."""
    wide = f"{SCALE}BD * (CAST({count} AS DECIMAL(20,0)) + 1BD) div CAST(nullif(words + kinds, 0) AS DECIMAL(20,0))"
    # A long holds 9.2 * 10^18.
    return f"1 + CASE WHEN {count} < 9000000000 THEN {SCALE}L * ({count} + 1) div nullif(words + kinds, 0) ELSE {wide} END"


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, words, kinds, lang_words, p0) of every group that occurs.

    ``words`` counts kept terms with their repeats, ``kinds`` the kept terms of the
    language, ``p0`` is the share of a term the source has not got.
    """
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    of_lang = kept.groupBy("lang").agg(F.sum("first").alias("kinds"), F.sum("n").alias("lang_words"))
    every = docs.select("lang", "source").distinct()
    filled = every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    # Without kept terms there is no share, and nothing to sum either.
    return filled.withColumn("p0", F.when(F.col("kinds") > 0, F.expr(share("0"))).otherwise(1))


def telling_terms(postings: DataFrame) -> DataFrame:
    """The terms a source has more of than its language, the farthest ones first."""
    far = (
        postings.withColumn("q", F.expr(share("total").replace("words", "lang_words")))
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    return _ranked(far).filter(F.col("rank") <= RANKS)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def one_sided(histograms: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over all terms as if no term were in both sources of a pair.

    One row per source, with how often each share occurs in it, meets the other
    sources of its language in blocks of about ``SOURCES``.
    """
    many = groups.groupBy("lang").agg((F.count("*") / SOURCES).cast("int").alias("blocks"))
    dealt = groups.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks") + 1))
    blocks = dealt.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    blocks = blocks.select(
        "lang", F.col("others.source").alias("others"), F.col("others.p0").alias("others_p0")
    )
    owners = (
        groups.join(histograms, ["lang", "source"], "left")
        .select("lang", "source", "p0", "kinds", "shares")
        .join(blocks, "lang")
        .select("lang", "source", "p0", "kinds", F.col("shares.p").alias("p"), F.col("shares.k").alias("k"),
                "others", "others_p0")
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lang, source, p0, kinds = row["lang"], row["source"], row["p0"], row["kinds"]
                p = np.array(row["p"] or [], np.int64)
                k = np.array(row["k"] or [], np.int64)
                q0 = np.array(row["others_p0"], np.int64)
                neither_to, neither_from = _apart(p0, q0), _apart(q0, p0)
                to, back = kinds * neither_to, np.zeros(len(q0), np.int64)
                for a in range(0, len(p), SHARES):
                    mine, times = p[a : a + SHARES, None], k[a : a + SHARES, None]
                    to = to + (times * (_apart(mine, q0) - neither_to)).sum(axis=0)
                    back = back + (times * (_apart(q0, mine) - neither_from)).sum(axis=0)
                others = row["others"]
                keep = [i for i, o in enumerate(others) if o != source]
                named = [others[i] for i in keep]
                yield {
                    "lang": [lang] * 2 * len(keep),
                    "source": [source] * len(keep) + named,
                    "item": named + [source] * len(keep),
                    "value": np.concatenate([to[keep], back[keep]]),
                }

    return map_batches(owners, run, "lang string, source string, item string, value long")


def pair_blocks(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs (left, right) of unlike rows of one term, ``PAIRS`` or one row's at once.

    ``begin`` and ``size`` give, for each row, where the rows of its term are.
    """
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        count = size[low:high]
        left = np.repeat(np.arange(low, high), count)
        inside = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        right = np.repeat(begin[low:high], count) + inside
        unlike = left != right
        yield left[unlike], right[unlike]
        low = high


def corrections(postings: DataFrame) -> DataFrame:
    """What terms that both sources of a pair have add to ``one_sided``."""
    slim = postings.select("lang", "term", "source", "p", "p0")
    parts = partitions(postings.sparkSession)
    ordered = slim.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")

    def coded(column):
        found = column.combine_chunks().dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy().astype(np.int64)

    def summed(rows):
        """Sums by pair over the rows of whole terms."""
        langs, lang = coded(rows["lang"])
        names, source = coded(rows["source"])
        _, term = coded(rows["term"])
        p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        many = np.diff(np.append(first, len(term)))
        for a, b in pair_blocks(np.repeat(first, many), np.repeat(many, many)):
            if not len(a):
                continue
            value = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            key = (lang[a] * len(names) + source[a]) * len(names) + source[b]
            order = np.argsort(key, kind="stable")
            starts = _starts(key[order])
            pairs = key[order][starts]
            yield {
                "lang": langs[pairs // len(names) ** 2].tolist(),
                "source": names[pairs // len(names) % len(names)].tolist(),
                "item": names[pairs % len(names)].tolist(),
                "value": np.add.reduceat(value[order], starts),
            }

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CORRECTED_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # The last term may go on.
            ends = [pc.equal(rows[c], rows[c][n - 1]) for c in ("lang", "term")]
            cut = n - pc.sum(pc.and_(*ends)).as_py()
            if cut:
                yield from summed(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), n - cut
        if n:
            yield from summed(pa.Table.from_batches(held))

    return map_batches(ordered, run, "lang string, source string, item string, value long")


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far each source's words are from other sources' and from its language's."""
    named = docs.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    )
    kept = staged(kept_terms(named), "terms")
    groups = staged(sizes(named, kept), "groups")
    postings = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n")))
    counted = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    # Distinct counts of one source: about the square root of its words at most.
    histograms = counted.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("shares"))
    parts = one_sided(histograms, groups).unionByName(corrections(postings))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = _ranked(summed.withColumn("part", F.lit("pair")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(telling_terms(postings).select(columns))


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (
  SELECT r, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n, coalesce(g.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) g USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // (g.lang_n + g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""
