"""Exact and semantic result cache over (namespace, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memstore.functions import vectors as V

MAX_ENTRIES, MAX_BYTES, THRESHOLD = 10_000, 64 * 1024 * 1024, 0.97


def fresh(now: int) -> Column:
    return F.col("ttl_secs").isNull() | (F.greatest(F.lit(now) - F.col("created_at"), F.lit(0)) < F.col("ttl_secs"))


def latest(rows: DataFrame, key: str = "cache_key") -> DataFrame:
    """The last put of each (namespace, key), by pos: an aggregation, so hot keys combine map-side."""
    rest = [c for c in rows.columns if c not in ("namespace", key)]
    return rows.groupBy("namespace", key).agg(F.max_by(F.struct(*rest), "pos").alias("__r")).select("namespace", key, "__r.*")


def get(rows: DataFrame, namespace: str, key: str, now: int, column: str = "cache_key") -> DataFrame:
    """The live entry, if it hasn't expired."""
    mine = rows.where((F.col("namespace") == namespace) & (F.col(column) == key))
    return latest(mine, column).where(fresh(now))


def delete(rows: DataFrame, namespace: str, key: str, column: str = "cache_key") -> DataFrame:
    return rows.where(~((F.col("namespace") == namespace) & (F.col(column) == key)))


def purged(rows: DataFrame, now: int, namespace: str | None = None, expired_only: bool = False) -> DataFrame:
    """The entries that a purge removes."""
    where = F.lit(True) if namespace is None else F.col("namespace") == namespace
    return rows.where(where & ~fresh(now) if expired_only else where)


def stats(rows: DataFrame, namespace: str | None = None) -> DataFrame:
    """Entries and bytes by namespace, expired ones included."""
    rows = rows if namespace is None else rows.where(F.col("namespace") == namespace)
    return rows.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("bytes"))


def within_budget(rows: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What is left after evicting the least recently used until both caps hold: the longest
    newest-first run that fits.  A namespace's rows are first cut to the newest max_entries by a
    rank that Spark limits in each task, so a window holds few rows however many there are."""
    newest = Window.partitionBy("namespace").orderBy(F.desc("accessed_at"), F.desc("pos"))
    rows = rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max_entries)
    total = F.sum("size_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__b", total).where(F.col("__b") <= max_bytes).drop("__n", "__b")


def semantic(rows: DataFrame, namespace: str, query: list[float], model: str, now: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The nearest entry of the namespace and model, if its cosine reaches the threshold; equal ones: the first put."""
    mine = rows.where((F.col("namespace") == namespace) & (F.col("model") == model) & F.col("vector").isNotNull())
    if now is not None:
        mine = mine.where(fresh(now))
    near = mine.withColumn("similarity", V.cosine(F.col("vector"), V.literal(query))).orderBy(F.desc("similarity"), "pos").limit(1)
    return near.where(F.col("similarity") >= threshold)
