"""The fixed relations, enums and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

from memstore.errors import DimensionMismatch, Invalid

MEMORY_TYPES = ("episodic", "semantic", "procedural", "working")
SCOPES = ("private", "shared")
ROLES = ("user", "assistant", "system")
DEFAULT_AGENT, DEFAULT_IMPORTANCE, DEFAULT_DIMENSIONS = "default", 0.5, 768
MAX_COUNT = 4294967295

RECORDS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("slot", T.LongType(), False),
    T.StructField("memory_type", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("agent_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("scope", T.StringType(), False),
    T.StructField("created_at", T.LongType(), False),
    T.StructField("importance", T.DoubleType(), False),
    T.StructField("ttl_secs", T.LongType(), True),
])
CATALOG = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("slot", T.LongType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("deleted", T.BooleanType(), False),
    T.StructField("accessed_at", T.LongType(), False),
    T.StructField("access_count", T.LongType(), False),
])
CACHE = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("key_hash", T.StringType(), False),
    T.StructField("key_preview", T.StringType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("created_at", T.LongType(), False),
    T.StructField("accessed_at", T.LongType(), False),
    T.StructField("access_count", T.LongType(), False),
    T.StructField("ttl_secs", T.LongType(), True),
    T.StructField("cost_hint_ms", T.LongType(), True),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("deleted", T.BooleanType(), False),
])


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    """The value in lower case, if it is allowed."""
    low = str(value).strip().lower()
    if low not in allowed:
        raise Invalid(f"unknown {what}: {value}")
    return low


def memory_type(value: str) -> str:
    return one_of(value, MEMORY_TYPES, "memory type")


def role(value: str) -> str:
    return one_of(value, ROLES, "role")


def check_vector(vector, dimensions: int) -> list[float]:
    if len(vector) != dimensions:
        raise DimensionMismatch(dimensions, len(vector))
    return [float(x) for x in vector]
