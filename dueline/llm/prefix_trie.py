"""The trie of conversations that begin alike, as a Z-fast trie.

A conversation is a string of turns. What its first d turns are is told by 128
bits: sums of hashes of (place, role, text), so they come from running sums and no
task needs a whole conversation for them. Equal conversations are one string, with
the number of them and the digest of their ids, which are streamed in order.

Strings are dealt to tasks by prefixes. A prefix with more than ``GROUP_STRINGS``
strings is crowded and dealt by its longer ones, so a first turn that a third of
all conversations share is many groups. Inside a group the strings are put into a
Z-fast trie (``ZFastTrie``): each compacted node is found in a table by the hash
at its handle, the depth that is divisible by the highest power of two among those
of its edge. The exit node of a string is located by fat binary search in as many
lookups as its length has bits; strings are located in batches against the trie as
it is, then inserted from where they were found. Edges are expanded to a row for
each depth at the end. The crowded prefixes, at most one in ``GROUP_STRINGS``
strings for each depth, get their values by sums over the groups below them.

Rows without a conv_id are in no conversation. Null role and text count as empty,
turns are in ascending order, nulls first, and turns of one number in the order of
a hash of role and text; repeated rows are turns each. An empty table has no
conversation and so no node. A worker holds the hashes of one group's turns (about
100 bytes each), not their texts. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm._support import map_batches, partitions, running_position, running_sums, staged
from dueline.llm.cascade import words_of

#: Strings below a prefix from which on it is dealt by longer prefixes.
GROUP_STRINGS = 250
#: Strings located at once, ids digested at once, rows of an Arrow batch.
BATCH = 256
PIECE_IDS = 8192
OUT_ROWS = 10_000
#: Conversations that share a head: c - c % FAMILY; heads have fewer than HEADS turns.
FAMILY, HEADS = 20, 4
_MASK = (1 << 32) - 1
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = (
    "k1 long, k2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, topmost boolean"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, x1, x2, words): turns numbered from 0, with hashes and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("x1"),
        F.xxhash64(text, F.lit(1), role).alias("x2"),
        F.size(words_of(text)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("x1"), F.col("x2")]
    return running_position(staged(slim, "turns"), ["conv_id"], order, F.lit(1), "i").drop("turn")


def with_heads_of_families(numbered: DataFrame) -> DataFrame:
    """(conv_id, d, x1, x2, words) of rebuilt conversations, d from 1.

    The first h turns, h from 0 to 3 by a checksum of the id, are those of the
    first conversation of the family, as far as it has them; the conversation's
    own turns follow from the h-th on.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = numbered.filter((F.col("conv_id") == base) & (F.col("i") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    convs = numbered.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    begin = convs.join(heads, "base").filter("i < h").select("conv_id", (F.col("i") + 1).alias("d"), "x1", "x2", "words")
    own = numbered.select("*", base.alias("base"), h.alias("h")).filter("i >= h").join(have, "base", "left")
    place = F.col("i") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0))) + 1
    return begin.unionByName(own.select("conv_id", place.alias("d"), "x1", "x2", "words"))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``rebuilt`` with k1, k2: 128 bits for the first d turns."""
    first = F.xxhash64("d", "x1", "x2")
    second = F.xxhash64("x2", "d", F.lit(1), "x1")
    lanes = [first.bitwiseAND(_MASK), F.shiftrightunsigned(first, 32), second.bitwiseAND(_MASK), F.shiftrightunsigned(second, 32)]
    laned = rebuilt.select("conv_id", "d", "words", *[v.alias(f"s{i}") for i, v in enumerate(lanes)])
    summed = running_sums(staged(laned, "rebuilt"), ["conv_id"], [F.col("d")], {f"b{i}": F.col(f"s{i}") for i in range(4)})
    low = [(F.col(f"s{i}") + F.col(f"b{i}")).bitwiseAND(_MASK) for i in range(4)]
    return summed.select(
        "conv_id",
        "d",
        F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("k1"),
        F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("k2"),
        "words",
    )


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _columns(schema: str, rows: list[tuple]) -> dict[str, list]:
    names = [c.split()[0] for c in schema.split(", ")]
    return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))


def strings(ends: DataFrame) -> DataFrame:
    """(conv_id, n, sha) of each distinct (d, k1, k2): smallest id, number, digest of the ids.

    The ids are written down in ranges of (string, id), in pieces; the digest of a
    string takes its pieces in order and keeps nothing but its state.
    """
    spark = ends.sparkSession
    key = ["k1", "k2", "d"]
    schema = "k1 long, k2 long, d long, part int, piece int, n long, conv_id long, ids binary"

    def pieces(batches):
        out = []
        for (*found, part), rows in groupby(_rows(batches), key=itemgetter(0, 1, 2, 4)):
            for piece in range(1 << 31):
                ids = [r[3] for r in islice(rows, PIECE_IDS)]
                if not ids:
                    break
                out.append((*found, part, piece, len(ids), ids[0], ",".join(map(str, ids)).encode()))
            if len(out) >= OUT_ROWS:
                yield _columns(schema, out)
                out = []
        if out:
            yield _columns(schema, out)

    def digests(batches):
        out = []
        for _, rows in groupby(_rows(batches), key=itemgetter(0, 1, 2)):
            n, state, least = 0, hashlib.sha256(), None
            for *_, count, first, ids in rows:
                state.update(ids if least is None else b"," + ids)
                least = first if least is None else least
                n += count
            out.append((least, n, state.hexdigest()))
            if len(out) >= OUT_ROWS:
                yield _columns("conv_id, n, sha", out)
                out = []
        if out:
            yield _columns("conv_id, n, sha", out)

    ranged = ends.select(*key, "conv_id").repartitionByRange(partitions(spark), *key, "conv_id")
    ordered = ranged.sortWithinPartitions(*key, "conv_id").withColumn("part", F.spark_partition_id())
    written = map_batches(ordered, pieces, schema)
    dealt = written.repartition(partitions(spark), *key).sortWithinPartitions(*key, "part", "piece")
    return map_batches(dealt, digests, "conv_id long, n long, sha string")


def fattest(low: int, high: int) -> int:
    """The number of (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of strings that agree in their first ``top`` + 1 turns.

    A string is a list with the hash of its first d turns at place d - top - 1. A
    node is an edge (low, high] of some string that runs through it.
    """

    def __init__(self, top: int):
        self.top, self.keys = top, []
        self.low, self.high, self.string, self.parent = [top - 1], [top], [-1], [-1]
        self.children: list[dict] = [{}]
        self.ends: list[int | None] = [None]
        self.handles: dict = {}

    def _key(self, string: int, depth: int):
        return self.keys[string][depth - self.top - 1]

    def _length(self, string: int) -> int:
        return self.top + len(self.keys[string])

    def _add(self, parent: int, high: int, string: int) -> int:
        low, node = self.high[parent], len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.string.append(string)
        self.parent.append(parent)
        self.children.append({})
        self.ends.append(None)
        self.children[parent][self._key(string, low + 1)] = node
        self.handles[self._key(string, fattest(low, high))] = node
        return node

    def locate(self, x: int, node: int = 0) -> tuple[int, int | None]:
        """Last node that a string runs through from ``node`` on, and the edge it leaves in."""
        low, high = self.high[node], self._length(x)
        end = high
        while low < high:
            f = fattest(low, high)
            found = self.handles.get(self._key(x, f))
            if found is None:
                high = f - 1
            elif self.high[found] <= end and self._key(x, self.high[found]) == self._key(
                self.string[found], self.high[found]
            ):
                node, low = found, self.high[found]
            else:
                return self.parent[found], found
        return node, self.children[node].get(self._key(x, low + 1)) if low < end else None

    def _split(self, edge: int, depth: int) -> int:
        low, high, string = self.low[edge], self.high[edge], self.string[edge]
        del self.handles[self._key(string, fattest(low, high))]
        upper = self._add(self.parent[edge], depth, string)
        self.low[edge], self.parent[edge] = depth, upper
        self.handles[self._key(string, fattest(depth, high))] = edge
        self.children[upper][self._key(string, depth + 1)] = edge
        return upper

    def _insert(self, x: int, node: int) -> None:
        node, edge = self.locate(x, node)
        end = self._length(x)
        if edge is not None:
            # How far the string stays in the edge: a binary search by hashes.
            same, differ = self.high[node], min(self.high[edge], end) + 1
            while differ - same > 1:
                middle = (same + differ) // 2
                if self._key(x, middle) == self._key(self.string[edge], middle):
                    same = middle
                else:
                    differ = middle
            node = self._split(edge, same)
        if self.high[node] < end:
            node = self._add(node, end, x)
        self.ends[node] = x

    def insert(self, strings: list[list]) -> None:
        """Takes a batch of distinct strings in."""
        first = len(self.keys)
        self.keys += strings
        found = [self.locate(x)[0] for x in range(first, len(self.keys))]
        for x, node in enumerate(found, first):
            self._insert(x, node)

    def downwards(self) -> list[int]:
        """All nodes, parents first."""
        out = [0]
        for node in out:
            out += self.children[node].values()
        return out


def nodes_of_group(top: int, members: list[tuple]) -> Iterator[tuple]:
    """Rows of ``_NODE`` for strings (conv_id, keys, words, n, sha) below depth ``top``."""
    trie = ZFastTrie(top)
    for a in range(0, len(members), BATCH):
        trie.insert([m[1] for m in members[a : a + BATCH]])
    order = trie.downwards()
    many = len(order)
    convs, leaves, saved, least = [0] * many, [0] * many, [0] * many, [None] * many
    for node in reversed(order):
        below = list(trie.children[node].values())
        ends = trie.ends[node]
        ids = [least[b] for b in below]
        convs[node] = sum(convs[b] for b in below)
        if ends is not None:
            ids.append(members[ends][0])
            convs[node] += members[ends][3]
        least[node] = min(ids)
        leaves[node] = sum(leaves[b] for b in below) or 1
        words = members[trie.string[node]][2][trie.low[node] - top : trie.high[node] - top] if node else ()
        saved[node] = sum(saved[b] for b in below) + (convs[node] - 1) * sum(words)
    for node in order:
        below = trie.children[node]
        ends = trie.ends[node]
        if node:
            _, keys, words, _, _ = members[trie.string[node]]
            rest = saved[node]
            for depth in range(trie.low[node] + 1, trie.high[node] + 1):
                last = depth == trie.high[node]
                yield (
                    *keys[depth - top - 1],
                    depth,
                    least[node],
                    least[node] if depth > trie.low[node] + 1 else None if depth == top + 1 else above[node],
                    convs[node],
                    len(below) if last else 1,
                    leaves[node],
                    rest,
                    members[ends][4] if last and ends is not None else NOTHING,
                    depth == top + 1,
                )
                rest -= (convs[node] - 1) * words[depth - top - 1]
        else:
            above = {}
        above.update((b, least[node]) for b in below.values())


def nodes_below(paths: DataFrame) -> DataFrame:
    """Rows of ``_NODE`` for all depths from ``start`` on, group by group."""
    spark = paths.sparkSession
    heads = paths.filter("d = start").select("conv_id", F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    rows = paths.filter("d >= start").join(heads, "conv_id")
    order = ["g1", "g2", "conv_id", "d"]
    slim = rows.select(*order, "k1", "k2", "words", "n", "sha")
    dealt = slim.repartition(partitions(spark), "g1", "g2").sortWithinPartitions(*order)

    def run(batches):
        out = []
        for _, group in groupby(_rows(batches), key=itemgetter(0, 1)):
            members = []
            for conv_id, path in groupby(group, key=itemgetter(2)):
                found = list(path)
                last = found[-1]
                members.append((conv_id, [r[4:6] for r in found], [r[6] for r in found], last[7], last[8]))
                top = found[0][3] - 1
            for row in nodes_of_group(top, members):
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield _columns(_NODE, out)
                    out = []
        if out:
            yield _columns(_NODE, out)

    return map_batches(dealt, run, _NODE)


def crowded_prefixes(paths: DataFrame) -> DataFrame:
    """(k1, k2, d) of the root and of prefixes of more than ``GROUP_STRINGS`` strings."""
    return (
        paths.groupBy("k1", "k2", "d")
        .agg(F.count("*").alias("strings"))
        .filter((F.col("strings") > GROUP_STRINGS) | (F.col("d") == 0))
        .drop("strings")
    )


def crowded_nodes(paths: DataFrame, crowded: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_NODE`` for crowded prefixes, and (conv_id, depth, parent_conv_id) of them and of groups.

    A node is known by its smallest member and its depth, and the ways up from it
    are that member's prefixes.
    """
    key = ["k1", "k2", "d"]
    way = paths.select("conv_id", *key)
    groups = below.filter("topmost").select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens")
    ends = paths.filter("n IS NOT NULL").join(crowded, key).select(*key, "conv_id", "n", "sha")
    # What ends at a prefix counts as if it were a group right below.
    parts = groups.unionByName(
        ends.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("n").alias("n_convs"),
                    F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    )
    summed = (
        parts.join(way, "conv_id")
        .filter("d < depth")
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")])
    )
    top = staged(
        summed.join(paths.select("conv_id", "d", "words"), ["conv_id", "d"]).withColumn(
            "own", (F.col("n_convs") - 1) * F.col("words")
        ),
        "crowded_nodes",
    )
    own = top.select("conv_id", F.col("d").alias("depth"), "own").join(way, "conv_id").filter("d <= depth")
    own = own.groupBy(*key).agg(F.sum("own").alias("own_below"))
    children = groups.select("conv_id", "depth").unionByName(
        top.filter("d > 0").select("conv_id", F.col("d").alias("depth"))
    )
    upwards = children.join(way, "conv_id").filter("d = depth - 1")
    many = upwards.groupBy(*key).agg(F.count("*").alias("n_children"))
    parents = upwards.join(top.select(*key, F.col("conv_id").alias("parent_conv_id")), key).select(
        "conv_id", "depth", "parent_conv_id"
    )
    whole = (
        top.join(own, key)
        .join(many, key, "left")
        .join(ends.select(*key, "sha"), key, "left")
        .select(
            "k1", "k2", F.col("d").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + F.col("own_below")).alias("saved_tokens"),
            F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"), F.lit(True).alias("topmost"),
        )
    )
    return whole, parents


def trie_of(rebuilt: DataFrame, ids: DataFrame) -> DataFrame:
    """Every node of the trie of conversations given by (conv_id, d, x1, x2, words).

    ``ids`` has every conv_id once, also of conversations without a turn.
    """
    rows = staged(prefixes(rebuilt), "prefixes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("d", "k1", "k2")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"last.{c}"), F.lit(0)).alias(c) for c in ("d", "k1", "k2")]
    )
    found = staged(strings(ends).join(ends, "conv_id").withColumnRenamed("d", "length"), "strings")
    at_end = F.col("d") == F.col("length")
    marks = [F.when(at_end, F.col(c)).alias(c) for c in ("n", "sha")]
    zero = F.lit(0).cast("long")
    roots = found.select("conv_id", *[zero.alias(c) for c in ("d", "k1", "k2", "words")], "length", "n", "sha")
    every = rows.join(found.select("conv_id", "length", "n", "sha"), "conv_id").unionByName(roots)
    paths = staged(every.select("conv_id", "d", "k1", "k2", "words", *marks), "paths")
    crowded = staged(crowded_prefixes(paths), "crowded")
    deepest = paths.join(crowded, ["k1", "k2", "d"]).groupBy("conv_id").agg((F.max("d") + 1).alias("start"))
    below = staged(nodes_below(paths.join(deepest, "conv_id")), "nodes")
    top, parents = crowded_nodes(paths, crowded, below)
    first = below.filter("topmost").unionByName(top).drop("parent_conv_id").join(parents, ["conv_id", "depth"], "left")
    return below.filter("NOT topmost").select(COLUMNS).unionByName(first.select(COLUMNS))


def families(conversations: DataFrame) -> DataFrame:
    """The nodes of all conversations, rebuilt on the heads of their families."""
    numbered = staged(turns(conversations), "numbered")
    return trie_of(with_heads_of_families(numbered), numbered.select("conv_id").distinct())


#: The same in DuckDB.
SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: CASE WHEN s % 2 = 1
             THEN xor(s // 2, 3988292384) ELSE s // 2 END, xor(a, b)), CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
u AS (
  SELECT c.conv_id, 0 AS own, t.i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= h
  UNION ALL
  SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM u),
p AS (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         sha256(array_to_string(list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY d), '')) AS k
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS l FROM p GROUP BY conv_id),
n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         string_agg(CASE WHEN d = l THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM p JOIN l USING (conv_id) GROUP BY d, k),
up AS (SELECT n.d, n.k, a.k AS pk FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up GROUP BY ALL),
m AS (
  SELECT n.*, coalesce(kids.n, 0) AS n_children, par.conv_id AS parent_conv_id FROM n
  LEFT JOIN kids USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN n par ON par.d = n.d - 1 AND par.k = up.pk),
s AS (
  SELECT a.d, a.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * m.words) AS saved
  FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM m JOIN s USING (d, k)"""
