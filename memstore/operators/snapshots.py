"""Snapshot lists and point-in-time lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("txn_id")


def as_of_txn(snapshots: DataFrame, txn: int) -> DataFrame:
    return snapshots.where(F.col("txn_id") == txn)


def as_of_time(snapshots: DataFrame, t: int) -> DataFrame:
    """The highest transaction made at or before t (by number, not by time)."""
    return snapshots.where(F.col("created_at") <= t).orderBy(F.desc("txn_id")).limit(1)


def retained(snapshots: DataFrame, keep: int = 256) -> DataFrame:
    """The newest `keep`; 0 keeps all."""
    return snapshots.orderBy(F.desc("txn_id")).limit(keep) if keep else snapshots
