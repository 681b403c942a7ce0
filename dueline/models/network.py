"""Networks of all points and folds of a search, trained together.

The model and the steps are those of Spark ML's perceptron: sigmoid layers, softmax
and cross entropy at the end, L-BFGS with a strong Wolfe line search from the same
start, and the loss the mean over stacks of ``stack`` rows of a partition, of which
the last may be smaller and then weighs as much. What differs is the work: rows are
packed once into blocks of a matrix each, kept on the executors, and a pass over the
blocks gives loss and gradient of every network at once, by products of whole
matrices. Tasks send partial sums, added up in a tree; the driver holds one optimiser
state per network (``CORRECTIONS`` pairs of weights). A search so costs as many
passes as its slowest network.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.models import joint

#: Pairs of steps and gradients a search direction is made of.
CORRECTIONS = 10
#: Rows of a block: few, so that their layers stay in the processor's cache.
_BLOCK = 256
#: Values the convergence test looks back on, and tries of a line search.
_MEMORY, _TRIES = 20, 10


@dataclass(frozen=True)
class Job:
    """One network: sizes of its layers, and the fold it does not see (None: it sees all)."""

    layers: tuple[int, ...]
    left_out: int | None

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in pairwise(self.layers))


def packed(rows: DataFrame, folds: int) -> RDD:
    """Blocks (x, y, fold, part, before) of rows with features, label and fold.

    ``part`` is the partition a block is from, ``before`` the rows before it there: all of
    them, then those of each fold. Kept as pickled arrays, which a pass reads as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                c = b.slice(at, _BLOCK)
                x = c.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                y = c.column(1).to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isin(y, (0, 1)).all():
                    raise ValueError("labels of a network have to be 0 or 1")
                fold = c.column(2).to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.RecordBatch.from_pydict({n: [v.tobytes()] for n, v in (("x", x), ("y", y), ("fold", fold))})

    def placed(part: int, blocks: Iterator) -> Iterator[tuple]:
        before = np.zeros(folds + 1, int)
        for b in blocks:
            y, fold = np.frombuffer(b["y"], "<f8"), np.frombuffer(b["fold"], "<i4")
            yield np.frombuffer(b["x"], "<f8").reshape(len(y), -1), y, fold, part, before
            before = before + _sizes(fold, folds)

    slim = rows.select(vector_to_array("features").alias("x"), "label", F.col("fold").cast("int").alias("fold"))
    return slim.mapInArrow(run, "x binary, y binary, fold binary").rdd.mapPartitionsWithIndex(placed)


def _sizes(fold: np.ndarray, folds: int) -> np.ndarray:
    """Rows, then those of each fold."""
    return np.append(len(fold), np.bincount(fold, minlength=folds))


def _counts(blocks: RDD, folds: int) -> dict[int, np.ndarray]:
    """Rows of each partition: all of them, then those of each fold."""

    def run(some):
        n = None
        for _, _, fold, part, before in some:
            n = part, before + _sizes(fold, folds)
        if n:
            yield n

    return dict(blocks.mapPartitions(run).collect())


def _seen(n: np.ndarray, job: Job) -> int:
    return int(n[0] if job.left_out is None else n[0] - n[1 + job.left_out])


def _layers(job: Job, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and bias of each layer."""
    out, at = [], 0
    for a, b in pairwise(job.layers):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def _forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives, the input first, the last one before the softmax."""
    out = [x]
    for i, (matrix, bias) in enumerate(layers):
        z = out[-1] @ matrix
        z += bias
        if i + 1 < len(layers):
            with np.errstate(over="ignore"):
                np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        out.append(z)
    return out


def _slope(layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted loss of some rows, and its gradient."""
    out = _forward(layers, x)
    z = out[-1] - out[-1].max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1)
    own = (np.arange(len(y)), y.astype(int))
    loss = weight @ (np.log(total) - z[own])
    delta = p / total[:, None]
    delta[own] -= 1
    delta *= weight[:, None]
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts += [delta.sum(axis=0), (out[i].T @ delta).ravel()]
        if i:
            delta = delta @ layers[i][0].T
            delta *= out[i]
            delta *= 1 - out[i]
    return np.concatenate([[loss], *parts[::-1]])


def _evaluated(blocks: RDD, jobs: list[Job], at: list[np.ndarray], counts, stack: int) -> list[np.ndarray]:
    """Loss and gradient of every job at its weights."""
    cuts = np.cumsum([0, *(1 + j.size for j in jobs)])

    def partial(some):
        total = np.zeros(cuts[-1])
        layers = [_layers(j, w) for j, w in zip(jobs, at, strict=True)]
        for x, y, fold, part, before in some:
            for k, job in enumerate(jobs):
                rows = slice(None) if job.left_out is None else fold != job.left_out
                n, seen = _seen(counts[part], job), y[rows]
                # Rows of the last, smaller stack of a partition weigh more.
                full = _seen(before, job) + np.arange(len(seen)) < n - n % stack
                weight = np.where(full, 1 / stack, 1 / max(n % stack, 1))
                total[cuts[k] : cuts[k + 1]] += _slope(layers[k], x[rows], seen, weight)
        yield total

    sums = blocks.mapPartitions(partial)
    if blocks.getNumPartitions() > joint.FAN:
        total = sums.treeReduce(np.add)
    else:
        total = sum(sums.collect())
    stacks = [sum(-(-_seen(n, j) // stack) for n in counts.values()) for j in jobs]
    return [total[a:b] / s for a, b, s in zip(cuts[:-1], cuts[1:], stacks, strict=True)]


class _NoStep(Exception):
    """A line search or a direction failed."""


Asks = Generator[np.ndarray, np.ndarray, tuple]


def _wolfe(x: np.ndarray, f: float, g: np.ndarray, d: np.ndarray, t: float) -> Asks:
    """A step along ``d`` that lowers the loss enough and flattens it: its length, loss, gradient."""
    slope = g @ d
    if slope > 0:
        raise _NoStep("uphill")

    def phi(t: float) -> Generator:
        found = yield x + d * t
        return t, found[1:] @ d, found[0], found[1:]

    def between(a, b) -> float:
        d1 = a[1] + b[1] - 3 * (a[2] - b[2]) / (a[0] - b[0])
        with np.errstate(invalid="ignore"):
            d2 = np.sqrt(d1 * d1 - a[1] * b[1])
        wide = b[0] - a[0]
        t = b[0] - wide * (b[1] + d2 - d1) / (b[1] - a[1] + 2 * d2)
        return a[0] + 0.1 * wide if t < a[0] + 0.1 * wide else a[0] + 0.9 * wide if t > a[0] + 0.9 * wide else t

    def zoom(low, high) -> Generator:
        for _ in range(_TRIES):
            c = yield from phi(between(high, low) if low[0] > high[0] else between(low, high))
            if c[2] > f + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
            else:
                if abs(c[1]) <= 0.9 * abs(slope):
                    return c
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _NoStep("zoom")

    low = (0.0, slope, f, g)
    for i in range(_TRIES):
        c = yield from phi(t)
        if not np.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > f + 1e-4 * t * slope or (c[2] >= low[2] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[1]) <= 0.9 * abs(slope):
            return c
        if c[1] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise _NoStep("no end")


def _direction(g: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Where to go from the gradient and the last steps, the newest first."""
    d = g.copy()
    if steps:
        bent = steps[0] @ turns[0]
        if not bent >= 0:
            raise _NoStep("not convex")
    held = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for s, u in zip(steps, turns, strict=True):
            rho = s @ u
            a = (s @ d) / rho
            if np.isnan(a):
                raise _NoStep("flat")
            d -= a * u
            held.append((a, rho))
        if steps:
            d *= bent / (turns[0] @ turns[0])
        for s, u, (a, rho) in zip(steps[::-1], turns[::-1], held[::-1], strict=True):
            d += (a - (u @ d) / rho) * s
    return -d


def _lbfgs(w: np.ndarray, passes: int, close: float) -> Asks:
    """Asks for loss and gradient at weights, until they settle; gives the weights."""
    found = yield w
    f, g = found[0], found[1:]
    first, values, steps, turns, failed = f, [np.inf], [], [], False
    step = 0
    while step < passes:
        if len(values) > 1 and abs(f - max(values)) <= close * first:
            break
        if np.linalg.norm(g) <= max(close * f, 1e-8):
            break
        try:
            d = _direction(g, steps, turns)
            t, _, new_f, new_g = yield from _wolfe(w, f, g, d, 1.0 if step else 1 / np.linalg.norm(d))
            if t * np.linalg.norm(g) < 1e-10:
                raise _NoStep("short")
        except _NoStep:
            if failed:
                break
            failed, steps, turns = True, [], []
            continue
        failed, move = False, d * t
        steps, turns = [move, *steps][:CORRECTIONS], [new_g - g, *turns][:CORRECTIONS]
        w, f, g = w + move, new_f, new_g
        values = [*values, f][-_MEMORY:]
        step += 1
    return w


def fit(
    blocks: RDD, folds: int, jobs: list[Job], starts: list[np.ndarray], passes: int, close: float, stack: int
) -> list[np.ndarray]:
    """Weights of every job, in the order Spark ML has them."""
    counts = _counts(blocks, folds)
    searches = [_lbfgs(w, passes, close) for w in starts]
    asked = {k: next(s) for k, s in enumerate(searches)}
    done: dict[int, np.ndarray] = {}
    while asked:
        some = list(asked)
        found = _evaluated(blocks, [jobs[k] for k in some], [asked[k] for k in some], counts, stack)
        for k, values in zip(some, found, strict=True):
            try:
                asked[k] = searches[k].send(values)
            except StopIteration as end:
                del asked[k]
                done[k] = end.value
    return [done[k] for k in range(len(jobs))]


def scored(blocks: RDD, jobs: list[Job], weights: list[np.ndarray]) -> DataFrame:
    """(job, label, score) of the rows that a job has not seen; the score is class 1 before the softmax."""

    def run(some):
        layers = [_layers(j, w) for j, w in zip(jobs, weights, strict=True)]
        for x, y, fold, _, _ in some:
            for k, job in enumerate(jobs):
                held = fold == job.left_out
                value = _forward(layers[k], x[held])[-1][:, 1]
                yield k, bytearray(y[held].tobytes()), bytearray(value.tobytes())

    def spread(batches):
        for b in batches:
            for k, y, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                y = np.frombuffer(y)
                yield pa.RecordBatch.from_pydict(
                    {"job": pa.array([k] * len(y), pa.int32()), "label": y, "score": np.frombuffer(value)}
                )

    spark = SparkSession.active()
    found = spark.createDataFrame(blocks.mapPartitions(run), "job int, label binary, score binary", verifySchema=False)
    return found.mapInArrow(spread, "job int, label double, score double")
