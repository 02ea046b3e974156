"""Similarity of float arrays as Columns, in double precision and left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memstore.errors import Invalid

METRICS = {"cosine": "cosine", "cos": "cosine", "l2": "l2", "euclidean": "l2", "dot": "dot", "ip": "dot"}


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def metric(name: str) -> str:
    try:
        return METRICS[str(name).strip().lower()]
    except KeyError:
        raise Invalid(f"unknown metric: {name}") from None


def similarity(name: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine, dot, or 1 / (1 + distance)."""
    kind = metric(name)
    return cosine(a, b) if kind == "cosine" else dot(a, b) if kind == "dot" else 1 / (1 + l2(a, b))


def part(vector: Column, sub: int, subspaces: int, dimensions: int) -> Column:
    """The sub-th of `subspaces` slices, bounds floor(s * dimensions / subspaces)."""
    lo, hi = sub * dimensions // subspaces, (sub + 1) * dimensions // subspaces
    return F.slice(vector, lo + 1, hi - lo)
