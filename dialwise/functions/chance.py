"""Repeatable chance: values that depend on a seed and a key, not on partitions or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RESOLUTION = 2.0**32


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) drawn by the seed and the keys, the same wherever it is computed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    leading = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return leading / F.lit(_RESOLUTION)


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2 … up to the resolution of ``uniform``."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 14):
        total += term
        steps.append(total)
        term /= k
    return [s for s in steps if s < 1.0 - 1.0 / _RESOLUTION]


def poisson_one(u: Column) -> Column:
    """The Poisson(1) count whose cumulative probability ``u`` falls into."""
    count = F.lit(0)
    for step in poisson_steps():
        count = count + (u >= F.lit(step)).cast("int")
    return count
