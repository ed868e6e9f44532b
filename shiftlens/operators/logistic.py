"""Penalised logistic regression by Newton steps over distributed sums.

The loss of the fitted monitors is convex and their features are few, so a handful of exact Newton
steps finds the optimum to machine precision, where a quasi-Newton search stops early on features
of very different scale. A step is one pass over the materialized feature table: every task adds
up loss, gradient and second derivatives of its rows, those sums are added up in a few groups, and
the driver solves one small system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize

#: Groups in which the tasks' sums are added up before the driver reads them.
GROUPS = 16
#: Most features: the driver solves a dense system of this size.
MOST_FEATURES = 2000


class LogisticFit(NamedTuple):
    """Stages that make the features, and the fitted coefficients."""

    prepare: PipelineModel
    coefficients: np.ndarray
    intercept: float
    steps: int

    def scores(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add the positive-class probability as ``score``."""
        values = vector_to_array(F.col(features))
        terms = F.zip_with(values, F.lit(self.coefficients.tolist()), lambda x, w: x * w)
        margin = F.aggregate(terms, F.lit(float(self.intercept)), lambda s, x: s + x)
        made = self.prepare.transform(rows)
        return made.select(*rows.columns, (1.0 / (1.0 + F.exp(-margin))).alias("score"))


def _sums(data: DataFrame, width: int, measure) -> np.ndarray:
    """Add up what ``measure`` returns for blocks of (features, label, weight)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, width)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            found = measure(x, y, w)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table["sums"].to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    made = data.mapInArrow(partial, "sums binary")
    if data.rdd.getNumPartitions() > GROUPS:
        part = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
        made = made.groupBy(part).applyInArrow(add, "sums binary")
    return sum(np.frombuffer(row.sums) for row in made.collect())


def fit(
    rows: DataFrame, stages: Sequence, *, features: str, label: str, weight: str, max_iter: int
) -> LogisticFit:
    """Minimise the weighted log loss plus half the squared coefficients, the intercept free."""
    prepare = Pipeline(stages=list(stages)).fit(rows)
    data = materialize(
        prepare.transform(rows).select(
            vector_to_array(F.col(features)).alias("x"),
            F.col(label).cast("double").alias("y"),
            F.col(weight).cast("double").alias("w"),
        )
    )
    width = len(data.first()["x"])
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features: at most {MOST_FEATURES} are fitted")
    moments = _sums(
        data, width, lambda x, y, w: np.concatenate([[len(x)], x.sum(axis=0), np.square(x).sum(axis=0)])
    )
    mean = moments[1 : width + 1] / moments[0]
    spread = _sums(data, width, lambda x, y, w: np.square(x - mean).sum(axis=0)) / moments[0]
    scale = np.where(spread > 0, np.sqrt(spread), 1.0)
    # Steps are taken on centred and scaled features; the penalty stays on the given ones.
    penalty = np.concatenate([[0.0], 1 / np.square(scale)])
    size = width + 1

    def state(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def measure(x, y, w):
            z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
            margin = z @ beta
            p = 1 / (1 + np.exp(-margin))
            loss = np.sum(w * (np.logaddexp(0, margin) - y * margin))
            second = (z * (w * p * (1 - p))[:, None]).T @ z
            return np.concatenate([[loss], z.T @ (w * (p - y)), second.ravel()])

        found = _sums(data, width, measure)
        loss = found[0] + np.sum(penalty * np.square(beta)) / 2
        return loss, found[1 : size + 1] + penalty * beta, found[size + 1 :].reshape(size, size) + np.diag(penalty)

    beta, steps = np.zeros(size), 0
    loss, gradient, second = state(beta)
    while steps < max_iter:
        move = np.linalg.solve(second, gradient)
        share = 1.0
        while True:
            after = state(beta - share * move)
            if after[0] <= loss * (1 + 1e-14) or share < 1e-6:
                break
            share /= 2
        beta, steps = beta - share * move, steps + 1
        loss, gradient, second = after
        if np.abs(share * move).max() <= 1e-12 * (1 + np.abs(beta).max()):
            break
    coefficients = beta[1:] / scale
    return LogisticFit(prepare, coefficients, float(beta[0] - coefficients @ mean), steps)
