"""Approximate index: inverted file over k-means partitions, product-quantized codes.

Postings are partitioned by `part`, so that a probe is partition pruning of the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.errors import Invalid

#: Bound of the training sample, Lloyd rounds, codewords of a subspace, defaults of a query.
SAMPLE, ROUNDS, CODEWORDS, N_PROBE, N_RERANK = 50_000, 25, 256, 8, 64
#: Centroids of assign(), products that its task holds at once, bound of their rounding.
MAX_CENTROIDS, CELLS, ROUNDING = 65_536, 1 << 22, 1e-12


def partition_count(n: int, wanted: int | None = None) -> int:
    return min(max(wanted or math.isqrt(max(n - 1, 0)) + 1, 1), max(n, 1))


def subspace_count(dimensions: int, wanted: int | None = None) -> int:
    return min(max(wanted or max(dimensions // 8, 1), 1), dimensions)


def bounds(dimensions: int, subspaces: int) -> list[tuple[int, int]]:
    return [(s * dimensions // subspaces, (s + 1) * dimensions // subspaces) for s in range(subspaces)]


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = (centre**2).sum(axis=1)[None] - 2 * (x @ centre.T)
    return d.argmin(axis=1)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means++ seeding and Lloyd's rounds; an empty one moves to a random point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = [x[rng.integers(len(x))]]
    gap = ((x - centre[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = gap.sum()
        pick = rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))
        centre.append(x[pick])
        gap = np.minimum(gap, ((x - x[pick]) ** 2).sum(axis=1))
    c = np.array(centre)
    for _ in range(rounds):
        home = nearest(x, c)
        count = np.bincount(home, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        new[count > 0] /= count[count > 0][:, None]
        new[count == 0] = x[rng.integers(len(x), size=int((count == 0).sum()))]
        if np.allclose(new, c):
            break
        c = new
    return c


@dataclass
class Index:
    """Centres (partitions x dimensions), codebooks (one array of codewords a subspace), defaults."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    n_probe: int = N_PROBE
    n_rerank: int = N_RERANK

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    def split(self) -> list[tuple[int, int]]:
        return bounds(self.dimensions, len(self.codebooks))


def train(mem: DataFrame, partitions: int | None = None, subspaces: int | None = None, n_probe: int = N_PROBE, n_rerank: int = N_RERANK, seed: int = 17) -> Index:
    """An index fitted on at most SAMPLE live rows, expired included, those of least slot hash."""
    rows = mem.where(~F.col("deleted")).select("slot", "vector")
    n = rows.count()
    if not n:
        raise Invalid("no live rows to index")
    ids = rows.select("slot").orderBy(F.xxhash64("slot"), "slot").limit(SAMPLE)
    sample = rows.join(F.broadcast(ids), "slot").orderBy("slot").select("vector").toPandas()["vector"]
    x = np.array([np.asarray(v, np.float64) for v in sample])
    centres = kmeans(x, partition_count(n, partitions), seed)
    m = subspace_count(x.shape[1], subspaces)
    books = [kmeans(x[:, lo:hi], CODEWORDS, seed + 1 + s, 12) for s, (lo, hi) in enumerate(bounds(x.shape[1], m))]
    return Index(centres, books, n_probe, n_rerank)


def encode(mem: DataFrame, index: Index) -> DataFrame:
    """postings (slot, part, code) of all live rows."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            code = np.stack([nearest(x[:, lo:hi], b) for (lo, hi), b in zip(index.split(), index.codebooks, strict=True)], axis=1).astype(np.uint8) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(x, index.centres) if batch.num_rows else [], pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["slot", "part", "code"])

    return mem.where(~F.col("deleted")).select("slot", "vector").mapInArrow(run, "slot long, part int, code binary")


def write_postings(postings: DataFrame, path: str) -> None:
    postings.repartition("part").sortWithinPartitions("slot").write.partitionBy("part").parquet(path)


def probe(index: Index, query: list[float], n_probe: int | None = None) -> list[int]:
    """The nearest partitions of a query, nearest first."""
    n = min(max(n_probe or index.n_probe, 1), len(index.centres))
    d = ((index.centres - np.asarray(query, np.float64)) ** 2).sum(axis=1)
    return np.argsort(d, kind="stable")[:n].tolist()


def candidates(postings: DataFrame, index: Index, query: list[float], n_probe: int | None = None, n_rerank: int | None = None) -> DataFrame:
    """(slot, rank) of the n_rerank nearest by table lookups in the probed partitions."""
    q, keep = np.asarray(query, np.float64), max(n_rerank or index.n_rerank, 1)
    width = max(len(b) for b in index.codebooks)
    lookup = np.zeros((len(index.codebooks), width))
    for s, ((lo, hi), b) in enumerate(zip(index.split(), index.codebooks, strict=True)):
        lookup[s, : len(b)] = ((b - q[lo:hi]) ** 2).sum(axis=1)
    sub = np.arange(len(index.codebooks))

    def scan(batches):
        d, slots = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            d = np.concatenate([d, lookup[sub, code].sum(axis=1)])
            slots = np.concatenate([slots, batch.column(0).to_numpy(zero_copy_only=False)])
            best = np.lexsort((slots, d))[:keep]
            d, slots = d[best], slots[best]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(d)], names=["slot", "distance"])

    found = postings.where(F.col("part").isin(probe(index, query, n_probe))).select("slot", "code").mapInArrow(scan, "slot long, distance double")
    top = found.orderBy("distance", "slot").limit(keep).collect()  # keep rows at most
    return postings.sparkSession.createDataFrame([(r["slot"], i) for i, r in enumerate(top)], "slot long, rank int")


def assign(mem: DataFrame, centroids: DataFrame) -> DataFrame:
    """(slot, part): the nearest of centroids (part, vector) by squared distance, the first on a tie.

    The centroids are few (partition_count): they are checked against MAX_CENTROIDS and go to
    every task as one matrix.  Matrix products choose those within rounding of the nearest,
    exact differences decide among them."""
    rows = centroids.orderBy("part").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise Invalid("too many centroids")
    if not rows:
        raise Invalid("no centroids")
    parts, centre = np.array([r["part"] for r in rows]), np.array([r["vector"] for r in rows], np.float64)
    norm = (centre**2).sum(axis=1)
    wide = max(1, CELLS // len(rows))

    def run(batches):
        for batch in (whole.slice(at, wide) for whole in batches for at in range(0, whole.num_rows, wide)):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            d = norm[None] - 2 * (x @ centre.T)
            near = d <= d.min(axis=1, keepdims=True) + ROUNDING * (norm.max() + (x**2).sum(axis=1, keepdims=True))
            best = d.argmin(axis=1)
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                some = np.flatnonzero(near[i])
                best[i] = some[np.array([squared(x[i], c) for c in centre[some]]).argmin()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts[best])], names=["slot", "part"])

    return mem.select("slot", "vector").mapInArrow(run, f"slot long, part {centroids.schema['part'].dataType.simpleString()}")


def squared(x: np.ndarray, y: np.ndarray) -> float:
    """The squared distance, summed in the vectors' order."""
    total = 0.0
    for d in (x - y).tolist():
        total += d * d
    return total


def info(postings: DataFrame, index: Index) -> DataFrame:
    return postings.agg(
        F.count("*").alias("vectors"), F.lit(len(index.centres)).alias("partitions"), F.lit(len(index.codebooks)).alias("subspaces"), F.lit(index.n_probe).alias("n_probe"), F.lit(index.n_rerank).alias("n_rerank"),
    )


def centroid_mean(mem: DataFrame, assigned: DataFrame) -> DataFrame:
    """(part, dim, mean) of each partition's vectors."""
    each = mem.join(assigned, "slot").select("part", F.posexplode("vector").alias("dim", "x"))
    return each.groupBy("part", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
