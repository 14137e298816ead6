"""Logistic fit with effects of categories beside numbers, by distributed Newton steps.

A histogram by age no longer suffices once system and area enter the model. Here equal rows of the
design are counted once (few beside the events: days of age x systems x area codes), and every step is
one pass over them: a task adds up gradient and curvature of its rows, the sums are added by place, and
the driver solves a system of as many unknowns as the model has. Nothing else leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.session import frozen

#: Most unknowns of a model: the driver solves a dense system of that size.
MOST_UNKNOWNS = 2000


@dataclass(frozen=True)
class LogitFit:
    """Names and values of the unknowns, whether the steps settled, and their number.

    The first level of a category (by name) has no unknown: others are relative to it.
    """

    names: tuple[str, ...]
    values: tuple[float, ...]
    settled: bool
    steps: int

    def __getitem__(self, name: str) -> float:
        return self.values[self.names.index(name)]


def _levels(rows: DataFrame, categories: Sequence[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for name in categories:
        # One more than allowed shows that there are too many; the driver never holds more.
        levels = rows.select(name).distinct().orderBy(name).limit(MOST_UNKNOWNS + 1).collect()
        found[name] = [r[0] for r in levels]
    if sum(map(len, found.values())) > MOST_UNKNOWNS:
        raise ValueError(f"the categories have more than {MOST_UNKNOWNS} levels")
    return found


def _design(batch: pa.RecordBatch, numbers: list[str], levels: dict[str, list[str]]) -> np.ndarray:
    """The matrix of a batch: constant, numbers, one column per further level."""
    columns = [np.ones(batch.num_rows)]
    columns += [batch[n].to_numpy(zero_copy_only=False).astype(float) for n in numbers]
    for name, known in levels.items():
        place = {level: i for i, level in enumerate(known)}
        at = np.array([place[x] for x in batch[name].to_pylist()], int)
        columns += [(at == i).astype(float) for i in range(1, len(known))]
    return np.stack(columns, 1)


def _sums(numbers: list[str], levels: dict[str, list[str]], values: np.ndarray):
    """Gradient and curvature of a partition as (place, value), the loss at the last place."""
    k = len(values)

    def run(batches):
        gradient, curvature, loss = np.zeros(k), np.zeros((k, k)), 0.0
        for batch in batches:
            x = _design(batch, numbers, levels)
            n, s = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n", "successes"))
            score = x @ values
            p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            gradient += x.T @ (s - n * p)
            curvature += (x * (n * p * (1 - p))[:, None]).T @ x
            loss += float((n * np.logaddexp(0, score) - s * score).sum())
        flat = np.concatenate([gradient, curvature.ravel(), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "value"])

    return run


def design_rows(
    rows: DataFrame, outcome: str, numbers: Sequence[str], categories: Sequence[str]
) -> DataFrame:
    """Equal rows of the design counted, in the shared folder; rows with a null in it are left out."""
    kept = rows.select(
        *[F.col(n).cast("double").alias(n) for n in numbers],
        *[F.col(c).cast("string").alias(c) for c in categories],
        F.col(outcome).cast("double").alias("_outcome"),
    ).dropna()
    counted = kept.groupBy(*numbers, *categories).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_outcome").alias("successes")
    )
    return frozen(counted, "design")


def logit_fit(
    rows: DataFrame, outcome: str, numbers: Sequence[str] = (), categories: Sequence[str] = (),
    ridge: float = 0.0, steps: int = 50, close: float = 1e-9,
) -> LogitFit:
    """Fit the chance of ``outcome`` (0 or 1) by numbers and categories.

    ``ridge`` penalises half the square of every unknown but the constant. Without rows all unknowns are
    0 and the fit is not settled.
    """
    numbers, categories = list(numbers), list(categories)
    counted = design_rows(rows, outcome, numbers, categories)
    levels = _levels(counted, categories)
    names = ["const", *numbers, *[f"{c}={x}" for c, known in levels.items() for x in known[1:]]]
    k = len(names)
    penalty = np.full(k, ridge)
    penalty[0] = 0

    def at(values: np.ndarray):
        sums = counted.mapInArrow(_sums(numbers, levels, values), "place int, value double")
        flat = np.zeros(k + k * k + 1)
        for r in sums.groupBy("place").agg(F.sum("value").alias("value")).collect():
            flat[r["place"]] = r["value"]
        curvature = flat[k:-1].reshape(k, k) + np.diag(penalty)
        return flat[:k] - penalty * values, curvature, flat[-1] + (penalty * values**2).sum() / 2

    values, settled, step = np.zeros(k), False, 0
    if counted.isEmpty():
        return LogitFit(tuple(names), tuple(values.tolist()), False, 0)
    gradient, curvature, loss = at(values)
    while step < steps and not settled:
        step += 1
        move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        share = 1.0
        while True:
            new = at(values + share * move)
            if new[2] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        settled = bool(np.abs(share * move).max() <= close * (1 + np.abs(values).max()))
        values = values + share * move
        gradient, curvature, loss = new
    return LogitFit(tuple(names), tuple(values.tolist()), settled, step)
