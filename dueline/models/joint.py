"""Linear models of all points and folds of a search, trained together.

Rows are packed once into blocks of a matrix each, kept on the executors. A pass
over the blocks gives, for every model at once, the loss, the gradient and the
matrix of second derivatives of the rows it may see; tasks send partial sums, which
are added up in a tree. The driver holds one optimiser state per model (points x
folds x width^2 numbers, width at most ``NEWTON_WIDTH``) and takes a damped Newton
step for each. So a search costs as many passes as its slowest model, not that
many for each fit.

Both kinds have the objective of common single-machine solvers: half the squared
weights plus C times the summed loss, the bias free. The hinge is taken quadratic
in the last ``SMOOTH`` before the margin, in steps from 2 on, which moves its value
by at most C * rows * SMOOTH / 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dueline.operators.ranges import running_totals

#: Widest vectors that are trained so, passes at most, partial sums added by one task.
NEWTON_WIDTH = 256
PASSES = 200
FAN = 32
#: Width of the rounded corner of the hinge, from coarse to fine.
SMOOTH = (2.0, 0.7, 0.25, 0.08, 0.03, 0.01)
#: What a step may still gain of the objective, at the last corner and before.
_CLOSE, _ROUGH = 1e-10, 1e-3


@dataclass(frozen=True)
class Job:
    """One model: its kind, its C, and the fold it does not see (None: it sees all)."""

    kind: str
    c: float
    left_out: int | None


def packed(rows: DataFrame) -> DataFrame:
    """Blocks (x, y, fold) of rows with features, label and fold, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                y = b.column(1).to_numpy(zero_copy_only=False).astype("<f8")
                fold = b.column(2).to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.RecordBatch.from_pydict({n: [v.tobytes()] for n, v in (("x", x), ("y", y), ("fold", fold))})

    slim = rows.select(vector_to_array("features").alias("x"), "label", F.col("fold").cast("int").alias("fold"))
    return slim.mapInArrow(run, "x binary, y binary, fold binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for x, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
            y = np.frombuffer(y, "<f8")
            yield np.frombuffer(x, "<f8").reshape(len(y), -1), y, np.frombuffer(fold, "<i4")


def summed(blocks: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the ``size`` numbers that ``part`` gives for each."""

    def partial(batches):
        total = np.zeros(size)
        for x, y, fold in _blocks(batches):
            total += part(x, y, fold)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    def added(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    sums = blocks.mapInArrow(partial, "v binary")
    parts = blocks.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(added, "v binary")
    total = np.zeros(size)
    for r in sums.collect():
        total += np.frombuffer(r["v"])
    return total


def _loss(kind: str, z: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of margins and its two derivatives."""
    if kind == "LogisticRegression":
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        return np.logaddexp(0, -z), -p, p * (1 - p)
    gap = 1 - z
    corner = (gap > 0) & (gap < smooth)
    loss = np.where(corner, gap * gap / (2 * smooth), np.maximum(gap - smooth / 2, 0) * (gap > 0))
    return loss, -np.clip(gap / smooth, 0, 1), corner / smooth


def _derivatives(jobs: list[Job], w: np.ndarray, mean: np.ndarray, scale: np.ndarray, smooth: float):
    """Loss, gradient and second derivatives of every job on one block, in one row each."""

    def part(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        sign = np.where(y > 0, 1.0, -1.0)
        margins = sign[:, None] * (x @ w.T)
        out = []
        for j, job in enumerate(jobs):
            seen = fold != (-1 if job.left_out is None else job.left_out)
            loss, first, second = _loss(job.kind, margins[:, j], smooth)
            gradient = x.T @ (seen * sign * first)
            weight = seen * second
            # Rows left out or off the corner of the hinge bend nothing.
            some = np.flatnonzero(weight)
            bent = (x[some] * weight[some, None]).T @ x[some]
            out.append(job.c * np.concatenate([[(seen * loss).sum()], gradient, bent.ravel()]))
        return np.concatenate(out)

    return part


def _moments(blocks: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, and mean and deviation of each feature; 1 for features that do not vary."""
    found = summed(
        blocks, 2 * width + 1, lambda x, y, fold: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
    )
    n = max(found[0], 1.0)
    mean = found[1 : width + 1] / n
    scale = np.sqrt(np.maximum(found[width + 1 :] / n - mean * mean, 0))
    scale[scale <= 1e-7 * (1e-5 + np.abs(mean))] = 1.0
    return n, mean, scale


def fit(blocks: DataFrame, width: int, jobs: list[Job]) -> np.ndarray:
    """Weights and bias of every job, one row each."""
    if width > NEWTON_WIDTH:
        raise ValueError(f"{width} features; at most {NEWTON_WIDTH} are trained together")
    n, mean, scale = _moments(blocks, width)
    ridge = np.append(1 / scale**2, 0.0)
    w = np.zeros((len(jobs), width + 1))
    if any(j.kind != "LogisticRegression" for j in jobs):
        # One model of all rows for each C is near those of its folds, which start there.
        whole = list(dict.fromkeys(Job(j.kind, j.c, None) for j in jobs))
        start = np.zeros((len(whole), width + 1))
        for smooth in SMOOTH:
            start = _newton(blocks, whole, start, mean, scale, ridge, smooth, n, _ROUGH)
        w = start[[whole.index(Job(j.kind, j.c, None)) for j in jobs]]
    w = _newton(blocks, jobs, w, mean, scale, ridge, SMOOTH[-1], n, _CLOSE)
    weights = w[:, :-1] / scale
    return np.column_stack([weights, w[:, -1] - weights @ mean])


def _newton(blocks, jobs, w, mean, scale, ridge, smooth, rows, close) -> np.ndarray:
    """Damped Newton steps for all jobs, until none would gain more than ``close``.

    A step that does not lower the objective is taken again with more damping.
    """
    side = w.shape[1]
    row = 1 + side + side * side
    now, value, tried = w.copy(), np.full(len(jobs), np.inf), w.copy()
    damping, held, gain = np.zeros(len(jobs)), [None] * len(jobs), np.zeros(len(jobs))
    open_ = list(range(len(jobs)))
    for _ in range(PASSES):
        some = [jobs[j] for j in open_]
        part = _derivatives(some, tried[open_], mean, scale, smooth)
        found = summed(blocks, len(some) * row, part).reshape(-1, row)
        still = []
        for j, f in zip(open_, found, strict=True):
            u, unit = tried[j], 1e-4 * jobs[j].c * rows
            loss = f[0] + 0.5 * (ridge * u * u).sum()
            if loss <= value[j] - 1e-4 * gain[j]:
                gradient = f[1 : side + 1] + ridge * u
                bent = f[side + 1 :].reshape(side, side) + np.diag(ridge)
                now[j], value[j], held[j] = u.copy(), loss, (gradient, bent)
                damping[j] = damping[j] / 8 if damping[j] > unit * 1e-3 else 0.0
                if gradient @ np.linalg.lstsq(bent, gradient, rcond=None)[0] <= close * (1 + abs(loss)):
                    continue
            elif damping[j] > 1e12 * unit:
                continue
            else:
                damping[j] = max(8 * damping[j], unit)
            gradient, bent = held[j]
            step = -np.linalg.lstsq(bent + damping[j] * np.eye(side), gradient, rcond=None)[0]
            tried[j], gain[j] = now[j] + step, -(gradient @ step) / 2
            still.append(j)
        open_ = still
        if not open_:
            break
    return now


def steepness(blocks: DataFrame, width: int, jobs: list[Job], weights: np.ndarray) -> np.ndarray:
    """Newton decrement of every job at its weights, relative to its objective.

    0 at an optimum: what a step along the second derivatives would still gain.
    """
    side = width + 1
    _, mean, scale = _moments(blocks, width)
    inside = np.column_stack([weights[:, :-1] * scale, weights[:, -1] + weights[:, :-1] @ mean])
    part = _derivatives(jobs, inside, mean, scale, SMOOTH[-1])
    found = summed(blocks, len(jobs) * (1 + side + side * side), part).reshape(len(jobs), -1)
    ridge = np.append(1 / scale**2, 0.0)
    out = []
    for u, f in zip(inside, found, strict=True):
        gradient = f[1 : side + 1] + ridge * u
        bent = f[side + 1 :].reshape(side, side) + np.diag(ridge)
        gain = gradient @ np.linalg.lstsq(bent, gradient, rcond=None)[0] / 2
        out.append(gain / (1 + f[0] + 0.5 * (ridge * u * u).sum()))
    return np.array(out)


def scored(blocks: DataFrame, jobs: list[Job], weights: np.ndarray) -> DataFrame:
    """(job, label, score) of the rows that a job has not seen."""

    def run(batches):
        for x, y, fold in _blocks(batches):
            for j, job in enumerate(jobs):
                held = fold == job.left_out
                if held.any():
                    margin = x[held] @ weights[j, :-1] + weights[j, -1]
                    yield pa.RecordBatch.from_pydict(
                        {"job": pa.array([j] * len(margin), pa.int32()), "label": y[held], "score": margin}
                    )

    return blocks.mapInArrow(run, "job int, label double, score double")


def areas(scores: DataFrame) -> dict[int, float]:
    """Area under the ROC curve of every job, ties at half; 0 if a class is missing."""
    counted = scores.groupBy("job", "score").agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")
    )
    placed = running_totals(counted, ["job"], "score", {"below": "n"}, {"all_p": "p", "all_n": "n"})
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    pairs = F.max(F.col("all_p") * F.col("all_n"))
    found = placed.groupBy("job").agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias("auc"))
    return {r["job"]: r["auc"] for r in found.collect()}


def cross_validated(with_folds: DataFrame, width: int, kind: str, cs: list[float], folds: int) -> list[float]:
    """Mean area over the folds for each C, from one training of all models."""
    jobs = [Job(kind, c, k) for c in cs for k in range(folds)]
    blocks = packed(with_folds).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = areas(scored(blocks, jobs, fit(blocks, width, jobs)))
    finally:
        blocks.unpersist()
    return [sum(found.get(i * folds + k, 0.0) for k in range(folds)) / folds for i in range(len(cs))]
