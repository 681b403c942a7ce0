"""Trees and forests of all points and folds of a search, grown together.

The trees are those of Spark ML: up to ``BINS`` bins a feature, cut by the counts of
some ``SAMPLE`` training rows (all, if there are fewer), the first split of most gain,
leaf siblings of one class merged. Draws differ: features of a node and copies of a
row come from hashes of the tree and the node or row, so a tree of less depth is the
top of a deeper one, and a smaller forest is the first trees of a larger one. Points
that differ only so share their trees.

Where the bins of all rows fit in ``ALONE``, tasks that hold the rows of a fold left out
grow whole trees. Else rows are binned once into blocks kept on the executors. Nodes of more than ``LOCAL``
training rows are split by sums of histograms over all blocks, a level of all trees in
a pass; smaller ones go with their rows to one task each, which grows the rest. Rows
of the left-out fold go down the same way, without weight, and come back as scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dueline.models import joint
from dueline.session import scratch_path
from dueline.sources.cache import write_text

#: Bytes of bins that one task takes.
ALONE = 1 << 27
#: Bins of a feature, rows they are learnt from, training rows of a node one task grows.
BINS, SAMPLE, LOCAL = 32, 10_000, 65_536
#: Nodes whose histograms are held at once by a task alone, sent as one, and how many such a pass makes.
_NODES, _SENT, _PASS = 512, 32, 256
_BLOCK = "x binary, y binary, fold binary, row binary"
# Chances of 0, 1, 2, .. copies of a row, summed up.
_COPIES = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, i + 1)) for i in range(18)])


@dataclass(frozen=True)
class Growth:
    """What trees have in common: impurity, least rows of a leaf, features a split sees, drawn rows."""

    impurity: str
    least: int
    seen: int
    drawn: bool


def seen(strategy: str, width: int, trees: int) -> int:
    """How many features a split may see, by Spark ML's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {
        "all": width, "sqrt": ceil(sqrt(width)), "log2": max(1, ceil(log(width) / log(2))), "onethird": ceil(width / 3),
    }
    if strategy in named:
        return named[strategy]
    return min(int(strategy), width) if strategy.isdigit() else ceil(float(strategy) * width)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders of the bins of a feature: halfway between values, after even counts if there are many."""
    v, n = np.unique(values, return_counts=True)
    middles = (v[:-1] + v[1:]) / 2
    if len(v) <= bins:
        return middles
    stride = len(values) / bins
    out, target, total = [], stride, np.cumsum(n)
    for i in range(1, len(v)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def learnt_cuts(rows: DataFrame, folds: int, seed: int, whole: bool = False) -> list[list[np.ndarray]]:
    """Borders of every feature for each fold left out, from a sample of the rows it leaves.

    With ``whole`` they are those of all rows only.
    """
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    n = sum(counts.values())
    share = SAMPLE / n if whole else SAMPLE * folds / (n * (folds - 1))
    some = rows.sample(False, share, seed) if share < 1 else rows
    found = some.select(vector_to_array("features").alias("x"), F.col("fold").cast("int")).toArrow().combine_chunks()
    fold = found.column(1).to_numpy()
    x = found.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
    out = []
    if whole:
        return [[_cuts(c, min(BINS, n)) for c in x.T]]
    for k in range(folds):
        bins = min(BINS, n - counts.get(k, 0))
        out.append([_cuts(c[fold != k], bins) for c in x.T])
    return out


def binned(rows: DataFrame, cuts: list[list[np.ndarray]]) -> DataFrame:
    """Blocks (x, y, fold, row) of rows with features, label and fold; x has the bins of every fold left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = b.column(1).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels of a tree have to be 0 or 1")
            bins = np.stack([
                np.stack([np.searchsorted(c, v) for c, v in zip(some, x.T, strict=True)], axis=1) for some in cuts
            ])
            parts = bins.astype("u1"), y.astype("u1"), b.column(2).to_numpy().astype("u1"), b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["x", "y", "fold", "row"])

    slim = rows.select(
        vector_to_array("features").alias("x"), "label", F.col("fold").cast("int").alias("fold"),
        F.monotonically_increasing_id().alias("row"),
    )
    return slim.mapInArrow(run, _BLOCK)


def unpacked(b: pa.RecordBatch, folds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, fold, row) of the blocks in a batch."""
    for x, y, fold, row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
        y = np.frombuffer(y, "u1")
        yield np.frombuffer(x, "u1").reshape(folds, len(y), -1), y, np.frombuffer(fold, "u1"), np.frombuffer(row, "<i8")


def gathered(blocks: DataFrame, sets: list[int], folds: int) -> RDD:
    """One partition for each set of bins, with its (set, x, y, fold, row) of all blocks."""

    def apart(records: Iterator) -> Iterator[tuple]:
        for r in records:
            block = pa.RecordBatch.from_pydict({n: [bytes(r[n])] for n in ("x", "y", "fold", "row")})
            for x, y, fold, row in unpacked(block, folds):
                for i, k in enumerate(sets):
                    yield i, (k, x[k].copy(), y, fold, row)

    return blocks.rdd.mapPartitions(apart).partitionBy(len(sets), lambda i: i).values()


def dealt(whole: RDD, groups: int) -> RDD:
    """(group, block) of every group and partition, one task for each pair; the first groups come first."""
    return whole.context.parallelize(range(groups), groups).cartesian(whole)


def joined(blocks: list[tuple], by_feature: bool) -> tuple[np.ndarray, ...]:
    """x, y, fold and row of the blocks of a set, in the order of their rows."""
    blocks.sort(key=lambda b: b[4][0])
    shape = sum(len(b[2]) for b in blocks), blocks[0][1].shape[1]
    x, at = np.empty(shape, "u1", "F" if by_feature else "C"), 0
    for b in blocks:
        x[at : at + len(b[2])] = b[1]
        at += len(b[2])
    return x.T if by_feature else x, *(np.concatenate([b[i] for b in blocks]) for i in (2, 3, 4))


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of 64 bits of some numbers."""
    z = np.zeros(1, "u8")
    with np.errstate(over="ignore"):
        for p in parts:
            z = (z ^ np.asarray(p).astype("u8")) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return z


def copies(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often each row stands in the sample of a tree, drawn with replacement."""
    return np.searchsorted(_COPIES, (mixed(seed, tree, row) >> np.uint64(11)) / 2.0**53, side="right")


def chosen(seed: int, tree: int, places: np.ndarray, width: int, k: int) -> np.ndarray:
    """The features that each node may split by, in order."""
    if k >= width:
        return np.broadcast_to(np.arange(width), (len(places), width))
    spots = mixed(seed + 1, tree, places[:, None], np.arange(width)[None, :])
    return np.sort(np.argpartition(spots, k - 1, axis=1)[:, :k], axis=1)


def _impurity(kind: str, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = np.maximum(n0 + n1, 1)
    p, q = n0 / n, n1 / n
    if kind == "gini":
        return 1 - p * p - q * q
    with np.errstate(divide="ignore", invalid="ignore"):
        return 0 - np.where(p > 0, p * (np.log(p) / log(2)), 0) - np.where(q > 0, q * (np.log(q) / log(2)), 0)


def _histogram(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Weights by node, feature, bin and class; ``at`` is the place of a row's node in ``features``."""
    c, k = features.shape
    b = x if k == x.shape[1] else np.take_along_axis(x, features[at], axis=1)
    spot = ((at[:, None] * k + np.arange(k)) * BINS + b) * 2 + y[:, None]
    return np.bincount(spot.ravel(), np.repeat(weight, k), c * k * BINS * 2).reshape(c, k, BINS, 2)


def _best(h: np.ndarray, growth: Growth) -> tuple[np.ndarray, ...]:
    """Gain, place of the feature, bin and weights to the left of the best split of each node."""
    left = h.cumsum(axis=2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    l0, l1 = left[..., 0], left[..., 1]
    r0, r1 = total[..., 0] - l0, total[..., 1] - l1
    nl, nr = l0 + l1, r0 + r1
    n = np.maximum(nl + nr, 1)
    gain = _impurity(growth.impurity, total[..., 0], total[..., 1])
    gain = gain - nl / n * _impurity(growth.impurity, l0, l1) - nr / n * _impurity(growth.impurity, r0, r1)
    gain = np.where((nl >= growth.least) & (nr >= growth.least), gain, -1.0).reshape(len(h), -1)
    spot = gain.argmax(axis=1)
    node = np.arange(len(h))
    where, cut = np.divmod(spot, BINS - 1)
    return gain[node, spot], where, cut, left[node, where, cut]


@dataclass
class Tree:
    """Nodes in the order they were made: children stand side by side after their parent."""

    level: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    parent: np.ndarray = field(default_factory=lambda: np.array([-1]))
    left: np.ndarray = field(default_factory=lambda: np.array([-1]))
    feature: np.ndarray = field(default_factory=lambda: np.array([0]))
    cut: np.ndarray = field(default_factory=lambda: np.array([0]))

    @staticmethod
    def at(level: int, place: int, weight: np.ndarray) -> Tree:
        return Tree(np.array([level]), np.array([place]), weight.reshape(1, 2).astype(float))

    def open(self, nodes: np.ndarray, growth: Growth, depth: int) -> np.ndarray:
        """Those of the nodes that may be split."""
        w = self.weight[nodes]
        mixed = np.abs(_impurity(growth.impurity, w[:, 0], w[:, 1])) >= 2.0**-52
        # Both children need the least rows.
        return nodes[mixed & (self.level[nodes] < depth) & (w.sum(axis=1) >= 2 * growth.least)]

    def split(self, nodes: np.ndarray, features: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Split nodes where there is a gain; gives the new nodes."""
        gain, where, cut, w = found
        wins = gain > 0
        some = nodes[wins]
        n, m = len(self.level), len(some)
        if not m:
            return some
        self.left[some] = n + 2 * np.arange(m)
        self.feature[some], self.cut[some] = features[wins, where[wins]], cut[wins]
        pair = np.stack([w[wins], self.weight[some] - w[wins]], axis=1).reshape(-1, 2)
        self.weight = np.concatenate([self.weight, pair])
        self.level = np.append(self.level, np.repeat(self.level[some] + 1, 2))
        self.place = np.append(self.place, (2 * self.place[some, None] + [0, 1]).ravel())
        self.parent = np.append(self.parent, np.repeat(some, 2))
        for name, value in (("left", -1), ("feature", 0), ("cut", 0)):
            setattr(self, name, np.append(getattr(self, name), np.full(2 * m, value)))
        return np.arange(n, n + 2 * m)

    def down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows one level further, where their node is split."""
        left = self.left[at]
        on = np.flatnonzero(left >= 0)
        out = at.copy()
        node = at[on]
        out[on] = left[on] + (x[on, self.feature[node]] > self.cut[node])
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (self.left[at] >= 0).any():
            at = self.down(x, at)
        return at

    def classes(self, depth: int, known: dict[int, int] | None = None) -> np.ndarray:
        """Class of each node that is one leaf when the tree ends at a depth, else -1; ``known`` is for open ends."""
        ends = (self.left < 0) | (self.level >= depth)
        out = np.where(ends, self.weight[:, 1] > self.weight[:, 0], -1).astype(int)
        for node, value in (known or {}).items():
            out[node] = value
        for level in range(self.level.max(), self.level[0], -1):
            # Children of one parent stand side by side.
            first = np.flatnonzero(self.level == level)[::2]
            up = self.parent[first]
            same = (out[first] == out[first + 1]) & (out[first] >= 0) & (self.level[up] < depth)
            out[up[same]] = out[first[same]]
        return out

    def tops(self, classes: np.ndarray) -> np.ndarray:
        """For each node the highest one over it that is one leaf, -1 if there is none."""
        out = np.where(classes >= 0, np.arange(len(classes)), -1)
        for level in range(self.level[0] + 1, self.level.max() + 1):
            nodes = np.flatnonzero(self.level == level)
            over = out[self.parent[nodes]]
            out[nodes] = np.where(over >= 0, over, out[nodes])
        return out

    def pruned(self, depth: int) -> Tree:
        """The tree of a depth, without what lies below nodes that are one leaf."""
        classes = self.classes(depth)
        tops = self.tops(classes)
        on = np.flatnonzero((tops < 0) | (tops == np.arange(len(tops))))
        number = np.full(len(tops) + 1, -1)
        number[on] = np.arange(len(on))
        left = np.where(classes >= 0, -1, self.left)[on]
        return Tree(self.level[on], self.place[on], self.weight[on], number[self.parent[on]], number[left], self.feature[on], self.cut[on])

    def share(self, nodes: np.ndarray) -> np.ndarray:
        """Share of class 1 in nodes."""
        return self.weight[nodes, 1] / np.maximum(self.weight[nodes].sum(axis=1), 1)


def grown(tree: Tree, x: np.ndarray, y: np.ndarray, weight: np.ndarray, growth: Growth, depth: int, key: tuple[int, int]) -> None:
    """Grow a tree of one node to its end, from rows with a weight."""
    some = np.flatnonzero(weight)
    x, y, weight, at = x[some], y[some], weight[some], np.zeros(len(some), int)
    front = tree.open(np.array([0]), growth, depth)
    while len(front):
        spot = np.full(len(tree.level), -1)
        spot[front] = np.arange(len(front))
        own = spot[at]
        # Rows of a node stand together, so that a level reads them in their order.
        order = np.flatnonzero(own >= 0)
        order = order[np.argsort(own[order], kind="stable")]
        x, y, weight, at, own = x[order], y[order], weight[order], at[order], own[order]
        new = []
        for a in range(0, len(front), _NODES):
            nodes = front[a : a + _NODES]
            lo, hi = np.searchsorted(own, [a, a + len(nodes)])
            features = chosen(*key, tree.place[nodes], x.shape[1], growth.seen)
            h = _histogram(x[lo:hi], y[lo:hi], weight[lo:hi], own[lo:hi] - a, features)
            new.append(tree.split(nodes, features, _best(h, growth)))
        at = tree.down(x, at)
        front = tree.open(np.concatenate(new), growth, depth)


@dataclass
class Search:
    """Trees of some growths: ``counts`` of them for a forest, to the ``depths``; a number for each tree."""

    growths: list[Growth]
    depths: list[int]
    counts: list[int]
    folds: int
    seed: int

    def numbers(self) -> list[int]:
        return list(range(len(self.growths) * self.folds * max(self.counts)))

    def of(self, number: int) -> tuple[Growth, int, int]:
        """Growth, fold left out and place in the forest of a tree."""
        rest, tree = divmod(number, max(self.counts))
        growth, fold = divmod(rest, self.folds)
        return self.growths[growth], fold, tree

    def weights(self, number: int, fold: np.ndarray, row: np.ndarray) -> np.ndarray:
        growth, out, tree = self.of(number)
        n = copies(self.seed, tree, row) if growth.drawn else 1
        return np.where(fold == out, 0, n).astype("u1")


def _tops(blocks: DataFrame, search: Search, width: int) -> list[Tree]:
    """The trees down to nodes of at most ``LOCAL`` training rows, which are left open."""
    spark, folds, most = blocks.sparkSession, search.folds, max(search.depths)

    def roots(batches):
        total = np.zeros((len(search.numbers()), 2))
        for b in batches:
            for _, y, fold, row in unpacked(b, folds):
                for i in search.numbers():
                    total[i] += np.bincount(y, search.weights(i, fold, row), 2)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["w"])

    parts = blocks.mapInArrow(roots, "w binary").toLocalIterator()
    trees = [Tree.at(0, 1, w) for w in sum(np.frombuffer(r["w"]).reshape(-1, 2) for r in parts)]
    fronts = {i: np.array([0]) for i in search.numbers()}

    def wide(i: int) -> np.ndarray:
        nodes = trees[i].open(fronts[i], search.of(i)[0], most)
        return nodes[trees[i].weight[nodes].sum(axis=1) > LOCAL]

    def passed(cut: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Split some nodes of some trees; gives the new nodes of each item."""
        features = [chosen(search.seed, search.of(i)[2], trees[i].place[f], width, search.of(i)[0].seen) for i, f in cut]

        def sums(batches):
            total = [np.zeros((*f.shape, BINS, 2)) for f in features]
            for b in batches:
                for x, y, fold, row in unpacked(b, folds):
                    for j, (i, front) in enumerate(cut):
                        at = trees[i].leaves(own := x[search.of(i)[1]])
                        spot = np.full(len(trees[i].level), -1)
                        spot[front] = np.arange(len(front))
                        weight = search.weights(i, fold, row)
                        on = np.flatnonzero((spot[at] >= 0) & (weight > 0))
                        total[j] += _histogram(own[on], y[on], weight[on], spot[at[on]], features[j])
            for j, h in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([h.tobytes()], pa.binary())], ["job", "h"])

        def best(key, table):
            j = key[0].as_py()
            h = sum(np.frombuffer(p) for p in table["h"].to_pylist())
            found = _best(h.reshape(*features[j].shape, BINS, 2), search.of(cut[j][0])[0])
            columns = [pa.array([np.asarray(v, "<f8").tobytes()], pa.binary()) for v in found]
            return pa.table([pa.array([j], pa.int32()), *columns], ["job", "gain", "place", "cut", "w"])

        summed = blocks.mapInArrow(sums, "job int, h binary").groupBy("job")
        new = []
        for r in summed.applyInArrow(best, "job int, gain binary, place binary, cut binary, w binary").collect():
            i, nodes = cut[r["job"]]
            gain, place, at, w = (np.frombuffer(r[c]) for c in ("gain", "place", "cut", "w"))
            values = gain, place.astype(int), at.astype(int), w.reshape(-1, 2)
            new.append((i, trees[i].split(nodes, features[r["job"]], values)))
        return new

    while fronts := {i: w for i in fronts if len(w := wide(i))}:
        cut = [(i, f[a : a + _SENT]) for i, f in fronts.items() for a in range(0, len(f), _SENT)]
        new: dict[int, list] = {i: [] for i in fronts}
        for a in range(0, len(cut), _PASS):
            for i, nodes in passed(cut[a : a + _PASS]):
                new[i].append(nodes)
        fronts = {i: np.concatenate(v) for i, v in new.items()}
    return trees


def _alone(whole: RDD, search: Search, pairs: list[tuple[int, int]], groups: int) -> DataFrame:
    """(group, row, label, s0, s1, ..) of rows left out: sums of scores over some trees, which a task grows from all rows of a set."""
    folds, most, last = search.folds, max(search.depths), max(search.counts)
    units = [(g, t) for g in range(len(search.growths)) for t in range(last)]

    def run(dealt: Iterator[tuple]) -> Iterator[tuple]:
        some = list(dealt)
        if not some:
            return
        share, k = some[0][0], some[0][1][0]
        x, y, fold, row = joined([b for _, b in some], False)
        some.clear()
        y, held = y.astype(int), fold == k
        out = x[held]
        own = units[share::groups]
        for g in dict.fromkeys(g for g, _ in own):
            growth, total = search.growths[g], np.zeros((len(pairs), len(out)))
            for t in (t for some, t in own if some == g):
                weight = search.weights((g * folds + k) * last + t, fold, row)
                tree = Tree.at(0, 1, np.bincount(y, weight, 2))
                grown(tree, x, y, weight, growth, most, (search.seed, t))
                leaf = tree.leaves(out)
                scores = [tree.share(tree.tops(tree.classes(depth))[leaf]) for depth in search.depths]
                for p, (j, n) in enumerate(pairs):
                    if t < n:
                        total[p] += scores[j]
            parts = row[held], y[held].astype(float), *total
            yield g * folds + k, *(bytearray(p.tobytes()) for p in parts)

    names = ["row", "label", *(f"s{p}" for p in range(len(pairs)))]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, row, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = np.frombuffer(row, "<i8")
                cols = [pa.array(np.full(len(row), g, "i4")), row, *map(np.frombuffer, values)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group", *names])

    bytes_of = "group int, " + ", ".join(f"{n} binary" for n in names)
    sums = SparkSession.active().createDataFrame(dealt(whole, groups).mapPartitions(run), bytes_of, verifySchema=False)
    parts = ", ".join(f"s{p} double" for p in range(len(pairs)))
    return sums.mapInArrow(spread, f"group int, row long, label double, {parts}")


def _ends(blocks: DataFrame, search: Search, trees: list[Tree]) -> DataFrame:
    """(tree, node, row, label, d0, d1, ..) of rows left out: the score each depth gives, by the node they came from.

    Row -1 has the class of the node where it is one leaf, else -1.
    """
    folds, most = search.folds, max(search.depths)
    names = ["bins", "y", "weight", "held", "row"]

    def sent(batches):
        for b in batches:
            for x, y, fold, row in unpacked(b, folds):
                for i, tree in enumerate(trees):
                    out = search.of(i)[1]
                    weight, held = search.weights(i, fold, row), fold == out
                    on = np.flatnonzero((weight > 0) | held)
                    at = tree.leaves(x[out][on])
                    for node in np.unique(at):
                        some = on[at == node]
                        parts = x[out][some], y[some], weight[some], held[some], row[some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i], pa.int32()), pa.array([node], pa.int32()),
                             *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                            ["tree", "node", *names],
                        )

    def end(key, table):
        i, node = key[0].as_py(), key[1].as_py()
        kinds = {"bins": "u1", "y": "u1", "weight": "u1", "held": "?", "row": "<i8"}
        x, y, weight, held, row = (np.frombuffer(b"".join(table[n].to_pylist()), kinds[n]) for n in names)
        x, y = x.reshape(len(y), -1), y.astype(int)
        growth, _, place = search.of(i)
        top = trees[i]
        tree = Tree.at(top.level[node], top.place[node], top.weight[node])
        grown(tree, x, y, weight, growth, most, (search.seed, place))
        leaf = tree.leaves(x[held])
        cols = [np.append(row[held], -1), np.append(y[held], 0)]
        for depth in search.depths:
            if tree.level[0] > depth:
                # The rows ended above; their node there has the score.
                cols.append(np.full(len(leaf) + 1, -1.0))
                continue
            classes = tree.classes(depth)
            cols.append(np.append(tree.share(tree.tops(classes)[leaf]), classes[0]))
        n = len(leaf) + 1
        return pa.table(
            [pa.array(np.full(n, i, "i4")), pa.array(np.full(n, node, "i4")), pa.array(cols[0]),
             pa.array(cols[1].astype(float)), *map(pa.array, cols[2:])],
            ["tree", "node", "row", "label", *(f"d{j}" for j in range(len(search.depths)))],
        )

    schema = "tree int, node int, row long, label double, " + ", ".join(f"d{j} double" for j in range(len(search.depths)))
    parts = blocks.mapInArrow(sent, "tree int, node int, " + ", ".join(f"{n} binary" for n in names))
    # Few bytes are much work here, so partitions are not merged by their size.
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "tree", "node").groupBy("tree", "node").applyInArrow(end, schema)


def _above(ends: DataFrame, search: Search, trees: list[Tree]) -> DataFrame:
    """Ends with the scores of nodes over them, where those are one leaf."""
    if all(len(t.level) == 1 for t in trees):
        return ends
    names = [f"d{j}" for j in range(len(search.depths))]
    known = ends.filter("row = -1").collect()
    rows = []
    per: dict[int, list] = {}
    for r in known:
        per.setdefault(r["tree"], []).append(r)
    for i, some in per.items():
        tops = []
        for name, depth in zip(names, search.depths, strict=True):
            told = {r["node"]: int(r[name]) for r in some if trees[i].level[r["node"]] <= depth}
            tops.append(trees[i].tops(trees[i].classes(depth, told)))
        for r in some:
            over = [int(t[r["node"]]) for t in tops]
            rows.append((i, r["node"], *(float(trees[i].share(np.array([o]))[0]) if o >= 0 else None for o in over)))
    schema = "tree int, node int, " + ", ".join(f"o{j} double" for j in range(len(names)))
    over = F.broadcast(ends.sparkSession.createDataFrame(rows, schema))
    both = ends.join(over, ["tree", "node"], "left")
    return both.select(
        "tree", "node", "row", "label", *[F.coalesce(f"o{j}", n).alias(n) for j, n in enumerate(names)]
    )


def cross_validated(with_folds: DataFrame, width: int, settings: list[dict], folds: int, seed: int, drawn: bool) -> list[float]:
    """Mean area over the folds for each setting of Spark ML's forest, from one growing of all trees."""
    points = []
    for s in settings:
        trees = s.get("numTrees", 1)
        growth = Growth(s.get("impurity", "gini"), s["minInstancesPerNode"], seen(s["featureSubsetStrategy"], width, trees), drawn)
        points.append((growth, s["maxDepth"], trees))
    growths, depths, counts = (list(dict.fromkeys(p)) for p in zip(*points, strict=True))
    search = Search(growths, depths, counts, folds, seed)
    most = max(counts)
    pairs = [(j, n) for j in range(len(depths)) for n in counts]
    blocks = binned(with_folds, learnt_cuts(with_folds, folds, seed))
    kept = []

    def keep(made):
        kept.append(made.persist(StorageLevel.MEMORY_AND_DISK))
        return made

    try:
        if with_folds.count() * width <= ALONE:
            groups = min(len(growths) * most, with_folds.sparkSession.sparkContext.defaultParallelism)
            parts = _alone(keep(gathered(blocks, list(range(folds)), folds)), search, pairs, groups)
            sums = [F.sum(f"s{p}").alias(f"s{p}") for p in range(len(pairs))]
            scores = parts.groupBy("group", "row", "label").agg(*sums)
        else:
            keep(blocks)
            trees = _tops(blocks, search, width)
            ends = keep(_ends(blocks, search, trees))
            sums = [F.sum(F.when(F.col("tree") % most < n, F.col(f"d{j}"))).alias(f"s{p}") for p, (j, n) in enumerate(pairs)]
            group = F.floor(F.col("tree") / most).cast("int").alias("group")
            scores = _above(ends, search, trees).filter("row >= 0").groupBy(group, "row", "label").agg(*sums)
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"s{p}").alias("score")) for p in range(len(pairs))]))
        long = scores.select("group", "label", each.alias("e")).select(
            (F.col("group") * len(pairs) + F.col("e.pair")).alias("job"), "label", F.round("e.score", 12).alias("score")
        )
        found = joint.areas(long)
    finally:
        for made in kept:
            made.unpersist()

    def area(point: tuple, k: int) -> float:
        g, pair = growths.index(point[0]), pairs.index((depths.index(point[1]), point[2]))
        return found.get((g * folds + k) * len(pairs) + pair, 0.0)

    return [sum(area(p, k) for k in range(folds)) / folds for p in points]


_SAVED = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def saved(number: int, tree: Tree, cuts: list[np.ndarray], value, impurity, stats: np.ndarray, gains) -> tuple[bytearray]:
    """The nodes of a tree as Spark ML saves them, as the bytes of an Arrow table."""
    n, inner = len(tree.left), tree.left >= 0
    offsets = np.concatenate([[0], np.cumsum(inner)]).astype("i4")
    most = max(map(len, cuts))
    borders = np.array([np.pad(c, (0, most - len(c))) for c in cuts]).reshape(len(cuts), most)
    limits = borders[tree.feature[inner], tree.cut[inner]]
    split = pa.StructArray.from_arrays(
        [np.where(inner, tree.feature, -1).astype("i4"), pa.ListArray.from_arrays(offsets, limits), np.full(n, -1, "i4")],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    rows = stats.sum(axis=1) if stats.shape[1] == 2 else stats[:, 0]
    node = {
        "id": np.arange(n, dtype="i4"), "prediction": value.astype(float), "impurity": impurity.astype(float),
        "impurityStats": pa.ListArray.from_arrays(np.arange(n + 1, dtype="i4") * stats.shape[1], stats.astype(float).ravel()),
        "rawCount": rows.astype("i8"), "gain": np.where(inner, gains, -1.0),
        "leftChild": np.where(inner, tree.left, -1).astype("i4"), "rightChild": np.where(inner, tree.left + 1, -1).astype("i4"),
        "split": split,
    }
    data = pa.StructArray.from_arrays([pa.array(v) for v in node.values()], list(node))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, number, "i4")), data], ["treeID", "nodeData"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return (bytearray(out.getvalue().to_pybytes()),)


def loaded(estimator: Estimator, model: type, tree: str, nodes: RDD, weights: list[float], width: int, **facts) -> Transformer:
    """A model of Spark ML from the nodes of its trees, read as one that it has saved."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    params = {
        "paramMap": {p.name: v for p, v in estimator._paramMap.items()},
        "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()},
    }
    head = {"timestamp": 0, "sparkVersion": spark.version}
    told = head | params | {
        "class": f"org.apache.spark.ml.classification.{model.__name__}", "uid": estimator.uid,
        "numFeatures": width, "numTrees": len(weights), **facts,
    }
    own = [json.dumps(head | {
        "class": f"org.apache.spark.ml.{tree}", "uid": f"{estimator.uid}_{i}", "paramMap": {}, "defaultParamMap": {},
    }) for i in range(len(weights))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for told in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(told)

    made = spark.createDataFrame(nodes, "nodes binary", verifySchema=False).mapInArrow(read, _SAVED)
    made.write.parquet(f"{path}/data")
    each = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(zip(own, weights, strict=True))], "_1 int, _2 string, _3 double")
    each.coalesce(1).write.parquet(f"{path}/treesMetadata")
    write_text(spark, f"{path}/metadata/part-00000", json.dumps(told))
    return model.load(path)


def refitted(rows: DataFrame, n: int, width: int, estimator: Estimator, setting: dict, seed: int, drawn: bool) -> Transformer:
    """The forest of one setting on all rows; by Spark ML where no task can hold their bins."""
    estimator = estimator.setParams(**setting)
    if n * width > ALONE:
        return estimator.fit(rows)
    count, depth = setting.get("numTrees", 1), setting["maxDepth"]
    growth = Growth(setting.get("impurity", "gini"), setting["minInstancesPerNode"], seen(setting["featureSubsetStrategy"], width, count), drawn)
    cuts = learnt_cuts(rows, 1, seed, whole=True)
    whole = gathered(binned(rows, cuts), [-1], 1).persist(StorageLevel.MEMORY_AND_DISK)
    groups = min(count, rows.sparkSession.sparkContext.defaultParallelism)

    def run(dealt: Iterator[tuple]) -> Iterator[tuple]:
        some = list(dealt)
        if not some:
            return
        share = some[0][0]
        x, y, _, row = joined([b for _, b in some], False)
        some.clear()
        y = y.astype(int)
        for t in range(share, count, groups):
            weight = (copies(seed, t, row) if drawn else np.ones(len(y))).astype("u1")
            tree = Tree.at(0, 1, np.bincount(y, weight, 2))
            grown(tree, x, y, weight, growth, depth, (seed, t))
            tree = tree.pruned(depth)
            w, kids = tree.weight, np.where(tree.left >= 0, tree.left, 0)
            impure, size = _impurity(growth.impurity, w[:, 0], w[:, 1]), w.sum(axis=1)
            inside = size[kids] * impure[kids] + size[kids + 1 - (tree.left < 0)] * impure[kids + 1 - (tree.left < 0)]
            yield saved(t, tree, cuts[0], w[:, 1] > w[:, 0], impure, w, impure - inside / np.maximum(size, 1))

    try:
        nodes = dealt(whole, groups).mapPartitions(run)
        name = "classification.DecisionTreeClassificationModel"
        return loaded(estimator, RandomForestClassificationModel, name, nodes, [1.0] * count, width, numClasses=2)
    finally:
        whole.unpersist()
