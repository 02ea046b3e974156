"""Scans, exact search and ranked recall.  Every function is a plan over DataFrames and `now`."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memstore.errors import DimensionMismatch, Invalid
from memstore.functions import vectors as V
from memstore.functions.scoring import Weights, score
from memstore.operators import filters as P
from memstore.schema import MAX_COUNT

#: Queries of one block: they go to every task.
MAX_QUERIES = 4096
#: Products that a task holds at once.
CELLS = 1 << 22
#: More than the rounding of a score in matrix products.
MARGIN = 1e-9


@dataclass(frozen=True)
class Request:
    query: list[float] = field(default_factory=list)
    top_k: int = 10
    memory_types: list[str] | None = None
    agent_id: str | None = None
    metric: str = "cosine"
    weights: Weights = Weights()
    n_probe: int | None = None
    n_rerank: int | None = None
    track_access: bool = True


def memories(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Record bodies with the catalog's slot, tombstone and access statistics."""
    own = ["slot", "deleted", "accessed_at", "access_count"]
    return records.drop(*own).join(catalog.select("id", *own, *(["version"] if "version" in records.columns else [])), ["id", *(["version"] if "version" in records.columns else [])])


def scan_live(mem: DataFrame) -> DataFrame:
    """Not deleted, expired included."""
    return mem.where(P.live())


def get(mem: DataFrame, key: str, value) -> DataFrame:
    """A live row by id or slot; an expired one is still found."""
    return mem.where((F.col(key) == value) & P.live())


def search(mem: DataFrame, query: list[float], k: int, now: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows that are live and not expired, by similarity, then slot."""
    sim = V.similarity(metric, F.col("vector"), V.literal(query))
    return mem.where(P.live() & ~P.expired(now)).withColumn("similarity", sim).orderBy(F.desc("similarity"), "slot").limit(k)


def eligible(mem: DataFrame, req: Request, now: int) -> DataFrame:
    return mem.where(P.live() & ~P.expired(now) & P.of_types(req.memory_types) & P.visible_to(req.agent_id))


def recall(mem: DataFrame, req: Request, now: int, candidates: DataFrame | None = None) -> DataFrame:
    """The top rows by score.  candidates (slot, rank), of an index: filters come after them,
    so fewer than k rows may remain, and equal scores keep the candidates' rank."""
    rows, tie = eligible(mem, req, now), "slot"
    if candidates is not None:
        rows, tie = rows.join(F.broadcast(candidates), "slot"), "rank"
    rows = rows.withColumn("similarity", V.similarity(req.metric, F.col("vector"), V.literal(req.query)))
    return rows.withColumn("score", score(F.col("similarity"), req.weights, now)).orderBy(F.desc("score"), tie).limit(req.top_k)


def _best(slim: DataFrame, ids: list, q: np.ndarray, req: Request) -> DataFrame:
    """(qid, slot, near) that each task passes on for one block of queries: the best top_k of its rows by
    the score in matrix products, with a margin for rounding."""
    kind, k, wide = V.metric(req.metric), req.top_k, max(1, CELLS // len(ids))

    def best(batches):
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        least = np.full(len(ids), -np.inf)
        for batch in (part.slice(at, wide) for part in batches for at in range(0, part.num_rows, wide)):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * q.shape[1]:
                raise DimensionMismatch(q.shape[1], len(flat) // batch.num_rows)
            x = flat.reshape(batch.num_rows, -1)
            s = q @ x.T
            if kind == "cosine":
                norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
            elif kind == "l2":
                s = 1 / (1 + np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * s, 0)))
            s = req.weights.similarity * s + batch.column(2).to_numpy(zero_copy_only=False)[None]
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            new = ~(s < least[:, None])
            for i in np.flatnonzero(new.any(axis=1)):
                v, w = np.concatenate([kept[i][0], s[i][new[i]]]), np.concatenate([kept[i][1], slot[new[i]]])
                if len(v) > k:
                    least[i] = np.partition(v, len(v) - k)[len(v) - k] - MARGIN
                    near = v >= least[i]
                    v, w = v[near], w[near]
                kept[i] = (v, w)
        n = [len(w) for _, w in kept]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([w for _, w in kept])), pa.array(np.concatenate([v for v, _ in kept]))], names=["qid", "slot", "near"])

    return slim.mapInArrow(best, "qid long, slot long, near double")


def recall_batch(mem: DataFrame, queries: DataFrame, req: Request, now: int) -> DataFrame:
    """Top rows for each of (qid, qvector), in blocks of MAX_QUERIES: a scan of the rows for each block.

    Each task ranks its rows by matrix products and passes on the best of each query, with a
    margin for rounding; what is among the best of all tasks, by the same margin, is scored
    exactly and ranked by a window over qid."""
    base = eligible(mem, req, now)
    slim = base.select("slot", "vector", score(F.lit(0.0), req.weights, now).alias("rest"))
    rows, blocks = queries.select("qid", "qvector").toLocalIterator(), []
    while block := list(itertools.islice(rows, MAX_QUERIES)):
        blocks.append(_best(slim, [r["qid"] for r in block], np.array([r["qvector"] for r in block], np.float64), req))
    if not blocks:
        return queries.select("qid").limit(0).crossJoin(mem.limit(0)).withColumn("similarity", F.lit(0.0)).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    asked, own = queries.select("qid", "qvector"), Window.partitionBy("qid")
    found = functools.reduce(DataFrame.unionAll, blocks).withColumn("__r", F.row_number().over(own.orderBy(F.desc("near"))))
    found = found.withColumn("__least", F.max(F.when(F.col("__r") == req.top_k, F.col("near"))).over(own) - MARGIN)
    found = found.where(F.col("__least").isNull() | (F.col("near") >= F.col("__least"))).select("qid", "slot")
    rows = base.join(found, "slot").join(F.broadcast(asked) if len(blocks) == 1 else asked, "qid")
    rows = rows.withColumn("similarity", V.similarity(req.metric, F.col("vector"), F.col("qvector"))).withColumn("score", score(F.col("similarity"), req.weights, now))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slot"))).where(F.col("rank") <= req.top_k).drop("qvector")


def touch(catalog: DataFrame, hits: DataFrame, key: str = "slot") -> DataFrame:
    """The catalog after accesses: hits (key, at) may repeat a row, each counts once."""
    fold = hits.groupBy(key).agg(F.max("at").alias("__at"), F.count("*").alias("__n"))
    out = catalog.join(fold, key, "left")
    out = out.withColumn("accessed_at", F.coalesce("__at", "accessed_at"))
    return out.withColumn("access_count", F.least(F.col("access_count") + F.coalesce("__n", F.lit(0)), F.lit(MAX_COUNT))).drop("__at", "__n")


def listing(mem: DataFrame, sort: str = "created", types: list[str] | None = None, agent: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Live rows by age (created), importance (highest first) or id; own rows of the agent only."""
    keys = {"created": [F.asc("created_at"), F.asc("slot")], "importance": [F.desc("importance"), F.asc("slot")], "id": [F.asc("id" if "id" in mem.columns else "slot")]}
    if sort not in keys:
        raise Invalid(f"unknown sort: {sort}")
    out = mem.where(P.live() & P.of_types(types) & P.owned_by(agent)).orderBy(*keys[sort])
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def about(mem: DataFrame, manifest_only: bool = False) -> DataFrame:
    """Onboarding rows of all agents, expired included: the manifest first, then by importance and age."""
    rows = mem.where(P.live() & P.onboarding()).withColumn("is_manifest", P.manifest())
    if manifest_only:
        rows = rows.where("is_manifest")
    return rows.orderBy(F.desc("is_manifest"), F.desc("importance"), "created_at", "slot")
