"""Linear support vector machines over random Fourier features, all folds and candidates of a grid in the same passes over the rows.

A machine for each fold and candidate is fitted by hinge loss with an L2 penalty on scaled features, as LinearSVC is, by the same quasi-Newton
steps. A pass takes the rows once and sums up loss and gradient of each machine at its own point, so a grid needs as many passes as its
slowest machine, not as all machines in turn; features are made anew in each pass and kept nowhere.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Callable, Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.operators import metrics
from mergelens.storage import table

ROWS_PER_FILE, ROWS_PER_BLOCK = 1 << 13, 1 << 10


def directions(width: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions for a gamma of 1/2, and phases; they follow from the seed and the sizes alone."""
    drawn = np.random.default_rng(seed)
    return drawn.normal(size=(width, size)), drawn.uniform(0, 2 * math.pi, size)


def fourier(x: np.ndarray, gamma: float, size: int, seed: int) -> np.ndarray:
    towards, phases = directions(x.shape[1], size, seed)
    return np.cos(x @ (towards * math.sqrt(2 * gamma)) + phases) * math.sqrt(2 / size)


def descent(size: int, rounds: int, memory: int = 10, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Quasi-Newton steps with a limited memory: yields points, is sent the value and the gradient there, returns the last point. Steps, line search and
    ends are those of the minimiser behind LinearSVC: a step goes no further than to 0 in any component, and a failed search forgets the history, once."""
    x, deltas, failed = np.zeros(size), deque(maxlen=memory), False
    value, slope = yield x
    values, first, turn = deque([value], maxlen=20), abs(value), 0
    while turn < rounds:
        way = slope.copy()
        used = []
        for step, change in reversed(deltas):
            rho = step @ change
            share = (step @ way) / rho if rho else math.nan
            way -= share * change
            used.append((share, rho, step, change))
        if used:
            way *= (used[0][2] @ used[0][3]) / (used[0][3] @ used[0][3])
        for share, rho, step, change in reversed(used):
            way += (share - (change @ way) / rho) * step
        way = np.where(-way * slope < 0, -way, 0.0)
        side = np.where(x != 0, np.sign(x), np.sign(-slope))
        down, shrink = way @ slope, 0.5 if turn else 0.1
        length = shrink * (1.0 if turn else 0.5 / max(np.linalg.norm(slope), 1e-300))  # its search never takes the first length
        found = None
        for left in reversed(range(19 if np.isfinite(way).all() and down < 0 else 0)):
            to = x + length * way
            to = np.where(np.sign(to) == side, to, 0.0)
            now, there = yield to
            if now > value + 1e-4 * length * down:
                length *= shrink
            elif there @ way < 0.9 * down:
                length *= 2.1
            elif there @ way > -0.9 * down:
                length *= shrink
            else:
                left = 0
            if not left:  # good, or the last that it tries
                found = to, now, there
                break
            if not 1e-10 <= length <= 1e10:
                break
        if found is None:
            if failed or not deltas:
                return x
            deltas.clear()
            failed = True
            continue
        to, now, there = found
        deltas.append((to - x, there - slope))
        x, value, slope, failed, turn = to, now, there, False, turn + 1
        near = abs(value - max(values)) <= tolerance * first or np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8)
        values.append(value)
        if near:
            return x
    return x


def _sums(rows: DataFrame, features: list[str], work: Callable) -> np.ndarray:
    """The sum of work(x, label, weight, fold), an array, over blocks of rows: by task, then in a tree."""

    def run(batches):
        total = 0
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features])
            label, weight, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold"))
            for at in range(0, len(x), ROWS_PER_BLOCK):
                own = slice(at, at + ROWS_PER_BLOCK)
                total = total + work(x[own], label[own], weight[own], fold[own])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    made = rows.select(*features, "label", "weight", "fold").mapInArrow(run, "sums binary").rdd
    return made.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)


def cross_validated(train: DataFrame, features: list[str], candidates: list[tuple[float, int, float]], folds: int, seed: int, rounds: int) -> list[float]:
    """The mean over the folds of the area under the ROC curve of each candidate (gamma, size, penalty); it is exact, by mid-ranks. train holds the features,
    label, weight and fold (from 0). Every fold is held out once from its machines' scale, features and fit. A fold with one class counts as 0 if it has
    no label 1 and else as 1."""
    picked = train.select(*[F.col(c).cast("double").alias(c) for c in [*features, "label", "weight"]], "fold")
    rows = table(picked.repartition(max(1, train.count() // ROWS_PER_FILE)), "folds")
    kept = [F.when(F.col("fold") != f, F.col(c)) for f in range(folds) for c in features]
    figures = rows.agg(F.array(*map(F.avg, kept)), F.array(*map(F.stddev_samp, kept))).first()
    mean, deviation = (np.array(x, float).reshape(folds, -1) for x in figures)
    inverse = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    maps = list(itertools.product(range(folds), dict.fromkeys((gamma, size) for gamma, size, _ in candidates)))
    scaled = lambda x, f: (x - mean[f]) * inverse[f]
    # of features their distance from what a row in the middle has is summed up, so that little is lost in the squares of narrow ones
    middle = {(gamma, size): fourier(np.zeros((1, len(features))), gamma, size, seed)[0] for _, (gamma, size) in maps}

    def spread(x, label, weight, fold):
        made = []
        for f, (gamma, size) in maps:
            own = fold != f
            z, w = fourier(scaled(x[own], f), gamma, size, seed) - middle[gamma, size], weight[own]
            made += [[w.sum(), (w * w).sum()], w @ z, w @ (z * z)]
        return np.concatenate(made)

    cuts = np.cumsum([2 + 2 * size for _, (_, size) in maps])[:-1]
    stands = {}
    for (f, (gamma, size)), part in zip(maps, np.split(_sums(rows, features, spread), cuts), strict=True):
        of, squares, first, second = part[0], part[1], part[2 : 2 + size] / part[0], part[2 + size :]
        variance = np.maximum(second - of * first * first, 0) / (of - squares / of)
        stands[f, (gamma, size)] = of, middle[gamma, size] + first, np.divide(1.0, np.sqrt(variance), out=np.zeros(size), where=variance > 1e-24)

    machines = [(f, (gamma, size), penalty) for f in range(folds) for gamma, size, penalty in candidates]

    def on_features(machine, point):
        """A point as coefficients of the features themselves, and the intercept."""
        _, centre, factor = stands[machine[:2]]
        return point[:-1] * factor, point[-1] - (point[:-1] * factor) @ centre

    def values(points: dict) -> dict:
        """Loss and gradient of each machine at its point."""
        by_map = {m: [k for k in points if machines[k][:2] == m] for m in maps}
        by_map = {m: (own, *(np.array(x).T for x in zip(*[on_features(machines[k], points[k]) for k in own], strict=True))) for m, own in by_map.items() if own}

        def work(x, label, weight, fold):
            made = []
            for (f, (gamma, size)), (_, factors, offsets) in by_map.items():
                own = fold != f
                z = fourier(scaled(x[own], f), gamma, size, seed)
                sign, w = 2 * label[own, None] - 1, weight[own, None]
                slack = 1 - sign * (z @ factors + offsets)
                pull = np.where(slack > 0, -sign * w, 0.0)
                made += [np.where(slack > 0, slack * w, 0.0).sum(axis=0), pull.sum(axis=0), (z.T @ pull).ravel()]
            return np.concatenate(made)

        total, found, at = _sums(rows, features, work), {}, 0
        for m, (own, *_) in by_map.items():
            (of, centre, factor), size, n = stands[m], m[1][1], len(own)
            loss, pull, slope = total[at : at + n], total[at + n : at + 2 * n], total[at + 2 * n : at + (2 + size) * n].reshape(size, n)
            at += (2 + size) * n
            for i, k in enumerate(own):
                point, penalty = points[k][:-1], machines[k][2]
                found[k] = loss[i] / of + penalty / 2 * point @ point, np.append((slope[:, i] - centre * pull[i]) * factor / of + penalty * point, pull[i] / of)
        return found

    runs = {k: descent(m[1][1] + 1, rounds) for k, m in enumerate(machines)}
    points, ends = {k: next(run) for k, run in runs.items()}, {}
    while points:
        for k, found in values(points).items():
            try:
                points[k] = runs[k].send(found)
            except StopIteration as end:
                del points[k]
                ends[k] = on_features(machines[k], end.value)

    def scores(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features])
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
            for f, pair in maps:
                own = fold == f
                z = fourier(scaled(x[own], f), *pair, seed)
                for k in [k for k, m in enumerate(machines) if m[:2] == (f, pair)]:
                    factors, offset = ends[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), k, np.int32)), pa.array(z @ factors + offset), pa.array(label[own].astype(np.int64))], ["machine", "score", "label"])

    scored = rows.select(*features, "label", "fold").mapInArrow(scores, "machine int, score double, label long")
    areas = dict(metrics.roc_auc(scored, ["machine"], digits=None).collect())
    if lone := [k for k in range(len(machines)) if areas.get(k) is None]:
        some = {r.fold for r in rows.where("label = 1").select("fold").distinct().collect()}
        areas |= {k: float(machines[k][0] in some) for k in lone}
    return [sum(areas[f * len(candidates) + i] for f in range(folds)) / folds for i in range(len(candidates))]
