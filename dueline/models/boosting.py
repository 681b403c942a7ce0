"""Boosted trees of all points and folds of a search, trained together.

The steps are those of Spark ML: labels -1 and 1, the first tree on them with weight
1, each other one on the slopes of the logistic loss with weight ``stepSize``, by
variance, in the bins of ``trees``. Rows are drawn without replacement and features
by node, both from hashes, which is what differs.

Where the bins of all rows fit in ``ALONE``, tasks that hold the rows of a fold left out
train whole models. Else a pass splits one level of the trees of every model, so a
search costs as many passes as one model of the deepest kind.

Rows lie in blocks of about ``BLOCK``, one for each fold left out and ``_MODELS`` points, with
the margins these models have reached. Tasks give histograms by model, which are added
up over the blocks; only the splits found come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from dueline.models import joint, trees
from dueline.session import shared_folder

#: Bytes of bins that one task takes, and codes that some features may have together.
ALONE, CODES = 1 << 26, 1024
#: Rows of a block, points that share a copy of it, rounds between checkpoints.
BLOCK, _MODELS, _KEPT = 60_000, 4, 20
_KEEP = StorageLevel.MEMORY_AND_DISK
# Below this a gain is rounding.
_NONE = 1e-13


@dataclass(frozen=True)
class Job:
    """One model: what a tree is like, and the fold it does not see."""

    left_out: int
    depth: int
    least: int
    step: float
    share: float
    seen: int
    rounds: int


@dataclass
class Block:
    """Rows with the bins of one fold left out, by feature; ``margins`` by job."""

    x: np.ndarray
    y: np.ndarray
    held: np.ndarray
    row: np.ndarray
    margins: dict[int, np.ndarray]


def _joint(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, in turn, as one code as long as few occur: codes of all rows, places of the bins, flags of each code."""
    most = min(CODES, max(trees.BINS, x.shape[1] // 64))
    out, codes, bins, done = [], None, np.zeros((1, 0), int), 0

    def close() -> None:
        nonlocal done
        places = (np.arange(done, done + bins.shape[1]) * trees.BINS + bins).ravel()
        there, own = np.unique(places, return_inverse=True)
        flags = np.zeros((len(bins), len(there)))
        flags[np.repeat(np.arange(len(bins)), bins.shape[1]), own] = 1.0
        out.append((codes, there, flags))
        done += bins.shape[1]

    for v in x:
        both = v.astype(int) if codes is None else codes.astype(int) * trees.BINS + v
        there = np.bincount(both, minlength=len(bins) * trees.BINS) > 0
        if codes is not None and there.sum() > most:
            close()
            both, bins = v.astype(int), np.zeros((1, 0), int)
            there = np.bincount(both, minlength=trees.BINS) > 0
        found = np.flatnonzero(there)
        bins = np.column_stack([bins[found // trees.BINS], found % trees.BINS])
        codes = (np.cumsum(there) - 1).astype("u2")[both]
    close()
    return out


@dataclass
class Alone:
    """All rows of a set of bins in one task, which trains whole models on them."""

    x: np.ndarray
    y: np.ndarray
    held: np.ndarray
    row: np.ndarray
    seed: int

    def __post_init__(self) -> None:
        self.joint = _joint(self.x)
        self.train, self.rest = np.flatnonzero(~self.held), np.flatnonzero(self.held)

    def sample(self, draw: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows drawn for a tree, and those that only get its scores."""
        if share >= 1:
            return self.train, self.rest
        some = (trees.mixed(self.seed + draw, 0, self.row[self.train]) >> np.uint64(11)) / 2.0**53 < share
        return self.train[some], np.concatenate([self.train[~some], self.rest])

    def counted(self, nodes: list[np.ndarray], slopes: np.ndarray) -> np.ndarray:
        """Rows and sums of slopes by node, feature and bin."""
        own, out = [slopes[rows] for rows in nodes], np.zeros((2, len(nodes), len(self.x) * trees.BINS))
        for codes, places, flags in self.joint:
            h = np.empty((2, len(nodes), len(flags)))
            for i, rows in enumerate(nodes):
                c = codes[rows].astype(np.intp)
                h[0, i] = np.bincount(c, minlength=len(flags))
                h[1, i] = np.bincount(c, own[i], len(flags))
            out[..., places] = h @ flags
        return out.reshape(2, len(nodes), -1, trees.BINS)

    def tree(self, jobs: list[Job], slopes: np.ndarray, draw: int) -> tuple[trees.Tree, list, np.ndarray] | None:
        """A tree with the rows and the gain of every node, or None if it is not the same for all jobs.

        Of two siblings the one with fewer rows is counted, the other has what is left of the parent.
        """
        job, width = jobs[0], len(self.x)
        tree, rows, gains = trees.Tree.at(0, 1, np.zeros(2)), [self.sample(draw, jobs[0].share)], np.full(1, -1.0)
        front, h = np.array([0]), self.counted([rows[0][0]], slopes)
        while len(front):
            may = trees.chosen(self.seed, draw, tree.place[front], width, job.seen)
            found = [_best(h, j, may) for j in {j.least: j for j in jobs}.values()]
            gain, feature, cut, left, own = found[0]
            wins = gain > 0
            for other in found[1:]:
                if not all(np.array_equal(np.where(wins, u, 0), np.where(other[0] > 0, v, 0)) for u, v in zip(found[0][:3], other, strict=False)):
                    return None
            tree.weight[front], gains[front] = own, np.where(wins, gain, -1.0)
            new = tree.split(front, np.broadcast_to(np.arange(width), (len(front), width)), (gain, feature, cut, left))
            gains = np.append(gains, np.full(len(new), -1.0))
            for p in front[wins]:
                bins, parts = self.x[tree.feature[p]], rows[p]
                right = [bins[r] > tree.cut[p] for r in parts]
                rows += [tuple(r[~m] for r, m in zip(parts, right, strict=True)), tuple(r[m] for r, m in zip(parts, right, strict=True))]
                rows[p] = None
            if not len(new) or tree.level[new[0]] == job.depth:
                break
            parents, h = h[:, wins], np.empty((2, len(new), width, trees.BINS))
            fewer = np.array([i + (len(rows[new[i + 1]][0]) < len(rows[new[i]][0])) for i in range(0, len(new), 2)])
            h[:, fewer] = self.counted([rows[new[i]][0] for i in fewer], slopes)
            h[:, fewer ^ 1] = parents - h[:, fewer]
            front = new
        return tree, rows, gains

    def trained(self, jobs: list[tuple[int, Job]]) -> Iterator[tuple[int, np.ndarray, list]]:
        """Margins and trees of models that differ only in the least rows of a leaf: one as long as they are the same."""
        todo = [(jobs, 0, np.zeros(len(self.y)), [])]
        while todo:
            some, at, margin, made = todo.pop()
            for draw in range(at, some[0][1].rounds):
                with np.errstate(over="ignore"):
                    slopes = 4 * self.y / (1 + np.exp(2 * self.y * margin)) if draw else self.y
                found = self.tree([j for _, j in some], slopes, draw)
                if found is None:
                    todo += [([j], draw, margin.copy(), list(made)) for j in some]
                    break
                tree, rows, gains = found
                value = tree.weight[:, 1] / np.maximum(tree.weight[:, 0], 1)
                step = some[0][1].step if draw else 1.0
                squares = np.zeros(len(value))
                for node, parts in enumerate(rows):
                    if parts is not None:
                        for r in parts:
                            margin[r] += value[node] * step
                        squares[node] = slopes[parts[0]] @ slopes[parts[0]]
                for node in range(len(value) - 1, 0, -1):
                    squares[tree.parent[node]] += squares[node]
                made.append((tree, value, gains, squares))
            else:
                for j, _ in some:
                    yield j, margin, made


def _alone(binned: DataFrame, jobs: list[Job], sets: list[int], folds: int, seed: int, give: Callable) -> tuple[RDD, RDD]:
    """The rows by set of bins, and what ``give`` makes of every model, trained by tasks that hold all rows of a set."""
    plan = []
    for k in sets:
        like: dict[Job, list] = {}
        for j, job in enumerate(jobs):
            if job.left_out == k:
                like.setdefault(replace(job, least=0), []).append((j, job))
        plan.append(sorted(like.values(), key=lambda some: -some[0][1].depth * some[0][1].rounds))
    place = {k: i for i, k in enumerate(sets)}

    def run(pairs: Iterator[tuple]) -> Iterator:
        pairs = list(pairs)
        if not pairs:
            return
        group, k = pairs[0][0], pairs[0][1][0]
        own = plan[place[k]]
        if group < len(own):
            x, y, fold, row = trees.joined([b for _, b in pairs], True)
            pairs.clear()
            whole = Alone(x, 2.0 * y - 1, fold == k, row, seed)
            for j, margin, made in whole.trained(own[group]):
                yield from give(j, whole, margin, made)

    whole = trees.gathered(binned, sets, folds).persist(_KEEP)
    return whole, trees.dealt(whole, max(map(len, plan))).mapPartitions(run)


def _blocks(binned: DataFrame, jobs: list[Job], folds: int) -> RDD:
    """One copy of the rows of a partition for each group of models."""
    groups = []
    for k in range(folds):
        own = [j for j, job in enumerate(jobs) if job.left_out == k]
        n = ceil(len(own) / _MODELS)
        groups += [(k, own[g::n]) for g in range(n)]

    def copied(records: Iterator) -> Iterator[tuple]:
        parts = [p for r in records for p in trees.unpacked(pa.RecordBatch.from_pydict({n: [bytes(r[n])] for n in ("x", "y", "fold", "row")}), folds)]
        if not parts:
            return
        x = np.concatenate([p[0] for p in parts], axis=1)
        y, fold, row = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        for g, (k, own) in enumerate(groups):
            yield (g, int(row[0])), Block(
                np.ascontiguousarray(x[k].T), 2.0 * y - 1, fold == k, row, {j: np.zeros(len(y)) for j in own}
            )

    made = binned.rdd.mapPartitions(copied)
    n = len(groups) * binned.rdd.getNumPartitions()
    # A task for each copy, as passes are short.
    return made.map(lambda b: (b[0][0] + len(groups) * b[0][1], b[1])).partitionBy(n, lambda key: key).values()


def _histogram(b: Block, job: Job, j: int, tree: trees.Tree, front: np.ndarray, draw: int, spots: np.ndarray) -> np.ndarray:
    """Rows and sums of what is left to explain, by node, feature and bin."""
    margin = b.margins[j]
    with np.errstate(over="ignore"):
        rest = 4 * b.y / (1 + np.exp(2 * b.y * margin)) if draw else b.y
    # Rows of other nodes, left out or not drawn fall in a place of their own.
    spot = np.full(len(tree.level), len(front))
    spot[front] = np.arange(len(front))
    at = spot[_leaves(tree, b.x)]
    at[b.held | (spots >= job.share)] = len(front)
    at *= trees.BINS
    out = np.empty((2, len(front), len(b.x), trees.BINS))
    cells = (len(front) + 1) * trees.BINS
    for f, x in enumerate(b.x):
        cell = at + x
        for i, h in enumerate((np.bincount(cell, minlength=cells), np.bincount(cell, rest, cells))):
            out[i, :, f] = h.reshape(-1, trees.BINS)[:-1]
    return out


def _leaves(tree: trees.Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(x.shape[1], int)
    if len(tree.level) == 1:
        return at
    rows = np.arange(x.shape[1])
    for _ in range(tree.level.max()):
        left = tree.left[at]
        at = np.where(left >= 0, left + (x[tree.feature[at], rows] > tree.cut[at]), at)
    return at


def _best(h: np.ndarray, job: Job, may: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gain, feature, bin, rows and sum to the left, and of the node, of the best split of each node."""
    total = h.cumsum(axis=3)
    n, s = total[0, :, :1, -1:], total[1, :, :1, -1:]
    nl, sl = total[0, ..., :-1], total[1, ..., :-1]
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (sl * sl / nl + sr * sr / nr - s * s / n) / n
    allowed = np.zeros(h.shape[1:3], bool)
    np.put_along_axis(allowed, may, True, axis=1)
    right = (nl >= job.least) & (nr >= job.least) & allowed[..., None] & (gain > _NONE)
    gain = np.where(right, gain, -1.0).reshape(h.shape[1], -1)
    spot, node = gain.argmax(axis=1), np.arange(h.shape[1])
    feature, cut = np.divmod(spot, trees.BINS - 1)
    left = np.stack([nl[node, feature, cut], sl[node, feature, cut]], axis=1)
    return gain[node, spot], feature, cut, left, np.stack([n.ravel(), s.ravel()], axis=1)


def _level(blocks: RDD, alone: bool, jobs: list[Job], grown: list, fronts: dict, draw: int, seed: int, width: int) -> dict:
    """Split the nodes of a level of every tree; gives the new ones."""
    open_trees = {j: grown[j] for j in fronts}
    may = {j: trees.chosen(seed, draw, grown[j].place[f], width, jobs[j].seen) for j, f in fronts.items()}

    def histograms(b: Block) -> Iterator[tuple[int, np.ndarray]]:
        # A row is in the sample of a model if its spot lies below the share of rows drawn.
        spots = (trees.mixed(seed + draw, 0, b.row) >> np.uint64(11)) / 2.0**53
        for j in b.margins:
            if j in fronts:
                yield j, _histogram(b, jobs[j], j, open_trees[j], fronts[j], draw, spots)

    sums = blocks.flatMap(histograms)
    if not alone:
        sums = sums.reduceByKey(np.add, max(1, min(len(fronts), blocks.getNumPartitions())))
    found = sums.map(lambda r: (r[0], _best(r[1], jobs[r[0]], may[r[0]]))).collect()
    out = {}
    for j, (gain, feature, cut, left, own) in found:
        tree, nodes = grown[j], fronts[j]
        tree.weight[nodes] = own
        new = tree.split(nodes, np.broadcast_to(np.arange(width), (len(nodes), width)), (gain, feature, cut, left))
        new = new[tree.level[new] < jobs[j].depth]
        if len(new):
            out[j] = new
    return out


def fit(binned: DataFrame, jobs: list[Job], folds: int, width: int, seed: int) -> RDD:
    """Blocks with the margins of every model after its last round."""
    shared_folder(binned.sparkSession)
    alone = binned.rdd.getNumPartitions() == 1
    blocks = _blocks(binned, jobs, folds).persist(_KEEP)
    for draw in range(max(j.rounds for j in jobs)):
        grown = [trees.Tree.at(0, 1, np.zeros(2)) for _ in jobs]
        fronts = {j: np.array([0]) for j, job in enumerate(jobs) if draw < job.rounds}
        last = blocks
        while fronts:
            fronts = _level(blocks, alone, jobs, grown, fronts, draw, seed, width)
        values = {}
        for j, tree in enumerate(grown):
            if draw < jobs[j].rounds:
                value = tree.weight[:, 1] / np.maximum(tree.weight[:, 0], 1)
                values[j] = tree, value * (jobs[j].step if draw else 1.0)

        def moved(b: Block, values=values) -> Block:
            for j in b.margins:
                if j in values:
                    tree, value = values[j]
                    b.margins[j] = b.margins[j] + value[_leaves(tree, b.x)]
            return b

        blocks = last.map(moved).persist(_KEEP)
        if draw % _KEPT == _KEPT - 1:
            blocks.checkpoint()
        blocks.count()
        last.unpersist()
    return blocks


def _held(b: Block) -> Iterator[tuple]:
    """(job, label, score) of the rows that a model of a block has not seen, as bytes."""
    for j, margin in b.margins.items():
        yield j, bytearray(((b.y[b.held] + 1) / 2).tobytes()), bytearray(margin[b.held].tobytes())


def _scores(found: RDD) -> DataFrame:
    """(job, label, score) of what ``_held`` gives."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, y, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                y = np.frombuffer(y)
                yield pa.RecordBatch.from_pydict(
                    {"job": pa.array([j] * len(y), pa.int32()), "label": y, "score": np.frombuffer(value)}
                )

    spark = SparkSession.active()
    made = spark.createDataFrame(found, "job int, label binary, score binary", verifySchema=False)
    return made.mapInArrow(spread, "job int, label double, score double")


def scored(blocks: RDD) -> DataFrame:
    """(job, label, score) of the rows that a model has not seen."""
    return _scores(blocks.flatMap(_held))


def _job(s: dict, left_out: int, width: int) -> Job:
    return Job(
        left_out, s["maxDepth"], s["minInstancesPerNode"], s["stepSize"], s["subsamplingRate"],
        trees.seen(s["featureSubsetStrategy"], width, 1), s["maxIter"],
    )


def cross_validated(with_folds: DataFrame, n: int, width: int, settings: list[dict], folds: int, seed: int) -> list[float]:
    """Mean area over the folds for each setting, from one training of all models.

    Where a task can hold the bins of all rows, it trains whole models.
    """
    jobs = [_job(s, k, width) for s in settings for k in range(folds)]
    cuts = trees.learnt_cuts(with_folds, folds, seed)
    rows = trees.binned(with_folds, cuts)
    blocks = None
    try:
        if n * width <= ALONE:
            blocks, found = _alone(
                rows, jobs, list(range(folds)), folds, seed,
                lambda j, whole, margin, made: _held(Block(whole.x, whole.y, whole.held, whole.row, {j: margin})),
            )
            found = joint.areas(_scores(found.persist(_KEEP)))
        else:
            rows = rows.repartition(ceil(n / BLOCK)).persist(_KEEP)
            blocks = fit(rows, jobs, folds, width, seed)
            found = joint.areas(scored(blocks))
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()
    return [sum(found.get(i * folds + k, 0.0) for k in range(folds)) / folds for i in range(len(settings))]


def refitted(rows: DataFrame, n: int, width: int, estimator: GBTClassifier, setting: dict, seed: int) -> GBTClassificationModel:
    """The model of one setting on all rows; by Spark ML where no task can hold their bins."""
    estimator = estimator.setParams(**setting)
    if n * width > ALONE:
        return estimator.fit(rows)
    job = _job(setting, -1, width)
    cuts = trees.learnt_cuts(rows, 1, seed, whole=True)

    def nodes(j: int, whole: Alone, margin: np.ndarray, made: list) -> Iterator[tuple]:
        for t, (tree, value, gains, squares) in enumerate(made):
            count, total = tree.weight.T
            spread = squares / np.maximum(count, 1) - value * value
            stats = np.column_stack([count, total, squares])
            yield trees.saved(t, tree, cuts[0], value, spread, stats, gains)

    whole, found = _alone(trees.binned(rows, cuts), [job], [-1], 1, seed, nodes)
    try:
        weights = [1.0] + [job.step] * (job.rounds - 1)
        return trees.loaded(estimator, GBTClassificationModel, "regression.DecisionTreeRegressionModel", found, weights, width)
    finally:
        whole.unpersist()
