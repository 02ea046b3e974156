"""The four-signal score."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


@dataclass(frozen=True)
class Weights:
    """Weights of similarity, recency, importance and frequency; half-life in seconds."""

    similarity: float = 1.0
    recency: float = 0.3
    importance: float = 0.2
    frequency: float = 0.1
    half_life: float = 604800.0


def recency(accessed_at: Column, now: int, half_life: float = Weights.half_life) -> Column:
    age = F.greatest(F.lit(now) - accessed_at, F.lit(0)).cast("double")
    return F.exp(F.lit(-LN2) * age / F.lit(float(half_life)))


def frequency(access_count: Column) -> Column:
    return F.log(access_count.cast("double") + 1)


def score(similarity: Column, w: Weights, now: int) -> Column:
    """Reads accessed_at, importance and access_count of the row."""
    return (
        F.lit(float(w.similarity)) * similarity + F.lit(float(w.recency)) * recency(F.col("accessed_at"), now, w.half_life)
        + F.lit(float(w.importance)) * F.col("importance").cast("double") + F.lit(float(w.frequency)) * frequency(F.col("access_count"))
    )


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
