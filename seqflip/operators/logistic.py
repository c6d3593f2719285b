"""Fit of the logistic regression (T3) on one-hot windows: MLlib's objective and solver, over packed cells.

MLlib holds every window as a sparse vector of doubles, some forty times its text, and reads all of them in each of some
eighty passes.  Here a window is the numbers of its cells (two bytes a position, see :func:`.perceptron.packed_blocks`), and
a pass is one Spark job that adds up the loss and its gradient by cell.  As in MLlib the features are centred and scaled by
their deviations while the solver runs, and the penalty is on the unscaled weights.  The driver holds the weights and
the solver's last steps only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import remove_path, scratch_path
from ..spec import SequenceSpec
from .perceptron import PARTS, even_parts, minimised, packed_blocks

#: Windows of a block, whose cells a task spreads out at a time, and the blocks of a part up to ``PARTS`` parts.
BLOCK, PART_BLOCKS = 1024, 300


def cell_sums(blocks: DataFrame, size: int, table: np.ndarray, offset: float, count: bool = False) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(windows, those of class 1, sums, counts) by one job.  ``table`` has the weights by cell, 0 for none; ``sums`` has the residual
    by cell, then that of all windows and the cross-entropy; ``counts`` the windows by cell if they are asked for."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((table, offset))
    small = np.uint16 if size < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        rows, ones, loss, every = 0, 0, 0.0, 0.0
        slope, held = np.zeros(size + 1), np.zeros(size + 1, np.int64)
        for b in batches:
            for n, grid, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                y = np.frombuffer(marks.as_buffer(), np.uint8)
                cells = np.frombuffer(grid.as_buffer(), small).reshape(n, -1).astype(np.intp)
                width = cells.shape[1]
                z = weights.take(cells, out=np.empty(cells.shape), mode="clip") @ np.ones(width) + start
                residual = 1.0 / (1.0 + np.exp(-z)) - y
                slope += np.bincount(cells.ravel(), np.repeat(residual, width), size + 1)
                if count:
                    held += np.bincount(cells.ravel(), minlength=size + 1)
                loss += float(np.logaddexp(0.0, z).sum() - z @ y)
                every += float(residual.sum())
                rows += n
                ones += int(y.sum())
        if rows:
            from pyspark import TaskContext

            sums = np.concatenate([slope[:size], [every, loss]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.int64()),
                                              pa.array([ones], pa.int64()), pa.array([sums.tobytes()], pa.binary()),
                                              pa.array([held[:size].tobytes()], pa.binary())], names=["part", "n", "n1", "sums", "counts"])

    parts = sorted(blocks.coalesce(PARTS).mapInArrow(run, "part int, n long, n1 long, sums binary, counts binary").toArrow().to_pylist(),
                   key=lambda r: r["part"])
    shared.destroy()
    return (sum(r["n"] for r in parts), sum(r["n1"] for r in parts), sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(size + 2)),
            sum((np.frombuffer(r["counts"], np.int64) for r in parts), np.zeros(size, np.int64)))


def scaled_loss(blocks: DataFrame, size: int, mean: np.ndarray, deviation: np.ndarray, reg_param: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Scaled weights and the intercept of centred features -> the objective and its gradient, by one job."""
    inverse = np.divide(1.0, deviation, out=np.zeros(size), where=deviation > 0)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights = x[:size] * inverse
        n, _, sums, _ = cell_sums(blocks, size, np.append(weights, 0.0), float(x[size] - weights @ mean))
        penalty = reg_param * x[:size] * inverse ** 2
        slope = inverse * (sums[:size] - sums[size] * mean) / n + penalty
        return float(sums[size + 1] / n + 0.5 * x[:size] @ penalty), np.append(slope, sums[size] / n)

    return objective


def fitted_logistic(train: DataFrame, spec: SequenceSpec, tokens: str, label: str, max_iter: int, reg_param: float,
                    tol: float) -> tuple[np.ndarray, float, float, int] | None:
    """(weights by cell, intercept, objective, iterations); ``None`` where the rows are not of two classes."""
    spark, size = train.sparkSession, spec.length * spec.alphabet
    path, blocks = scratch_path(spark, "logistic"), None
    try:
        blocks = even_parts(packed_blocks(train, spec, tokens, label, path, BLOCK), PART_BLOCKS)
        n, n1, _, counts = cell_sums(blocks, size, np.zeros(size + 1), 0.0, count=True)
        if not 0 < n1 < n:
            return None
        mean = counts / n
        deviation = np.sqrt(mean * (1.0 - mean) * (n / (n - 1)))
        start = np.append(np.zeros(size), np.log(n1 / (n - n1)))
        x, value, iterations = minimised(scaled_loss(blocks, size, mean, deviation, reg_param), start, max_iter, tol)
        weights = np.divide(x[:size], deviation, out=np.zeros(size), where=deviation > 0)
        return weights, float(x[size] - weights @ mean), value, iterations
    finally:
        if blocks is not None:
            blocks.unpersist()
        remove_path(spark, path)
