"""Predicates over the memory relation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memstore.functions.text import metadata_text


def live() -> Column:
    return ~F.col("deleted")


def expired(now: int) -> Column:
    """A ttl is set and has run out; a ttl of 0 runs out at once."""
    return F.col("ttl_secs").isNotNull() & (F.lit(now) - F.col("created_at") >= F.col("ttl_secs"))


def of_types(types: list[str] | None) -> Column:
    """None: all; an empty list: none."""
    return F.lit(True) if types is None else F.col("memory_type").isin(list(types)) if types else F.lit(False)


def visible_to(agent: str | None) -> Column:
    """The agent's own rows and shared ones; None: all."""
    return F.lit(True) if agent is None else (F.col("agent_id") == agent) | (F.col("scope") == "shared")


def owned_by(agent: str | None) -> Column:
    return F.lit(True) if agent is None else F.col("agent_id") == agent


def onboarding() -> Column:
    return F.coalesce(metadata_text(F.col("metadata"), "area") == "onboarding", F.lit(False))


def manifest() -> Column:
    return F.coalesce(metadata_text(F.col("metadata"), "topic") == "manifest", F.lit(False))
