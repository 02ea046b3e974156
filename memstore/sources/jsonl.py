"""JSON lines in and out, and query vectors as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memstore.errors import Invalid
from memstore.schema import DEFAULT_AGENT, DEFAULT_IMPORTANCE, MEMORY_TYPES, SCOPES

LINES = "id string, accessed_at long, access_count long, content string, vector array<float>, memory_type string, agent_id string, importance double, session_id string, scope string, created_at long, ttl_secs long, metadata string, _corrupt_record string"


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSONL file.  content and vector are required; blank lines are skipped; any
    other bad line fails the whole import.  An unknown memory type is read as semantic."""
    return _memories(spark.read.schema(LINES).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def memories_of(lines: DataFrame) -> DataFrame:
    """The same of lines at hand, in a column `value`."""
    return _memories(lines.where("trim(value) <> ''").select(F.from_json("value", LINES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*"))


def first_bad_line(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and text of the first line that an import fails on, or None.

    Lines are numbered by their place in the file's splits: of each split Spark counts the
    lines and finds its first bad one, so only one row for each split reaches the driver."""
    lines = spark.read.text(path).select("value", F.input_file_block_start().alias("at"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("m"))
    row = F.from_json("value", LINES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    blank = F.trim("value") == ""
    lines = lines.withColumn("r", row).withColumn("bad", ~blank & (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.content").isNull() | F.col("r.vector").isNull()))
    splits = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"), F.min(F.when(F.col("bad"), F.struct("m", F.substring("value", 1, 200).alias("value")))).alias("bad"))
    before = 0
    for s in splits.orderBy("file", "at").collect():
        if s["bad"] is not None:
            return before + s["bad"]["m"] - s["first"] + 1, s["bad"]["value"]
        before += s["n"]
    return None


def _memories(rows: DataFrame) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull() | F.col("content").isNull() | F.col("vector").isNull()
    fail = F.raise_error(F.concat(F.lit("bad line: "), F.coalesce(F.substring("_corrupt_record", 1, 200), F.col("content"), F.lit("content or vector is missing"))))
    kind, scope = F.lower("memory_type"), F.lower("scope")
    return rows.select(
        F.when(bad, fail).otherwise(F.col("content")).alias("content"), F.when(bad, fail.cast("array<float>")).otherwise(F.col("vector")).alias("vector"),
        F.when(kind.isin(*MEMORY_TYPES), kind).otherwise("semantic").alias("memory_type"), F.coalesce("agent_id", F.lit(DEFAULT_AGENT)).alias("agent_id"),
        F.least(F.greatest(F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)), F.lit(0.0)), F.lit(1.0)).alias("importance"),
        "id", "accessed_at", "access_count", "session_id", F.when(scope.isin(*SCOPES), scope).otherwise("private").alias("scope"), "created_at", "ttl_secs", "metadata",
    )


def perf_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of measurements as contents of episodic memories with area = performance."""
    schema = "version string, measured_at string, metric string, label string, value double, units string, build string, corpus string, notes string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    content = F.concat_ws(" ", F.format_string("[%s] %s: %s %s", "version", F.coalesce("label", "metric"), F.col("value").cast("string"), "units"), "notes")
    meta = F.to_json(F.struct(F.lit("performance").alias("area"), "metric", "version", "value", "units", "build", "corpus", "measured_at"))
    return rows.select(content.alias("content"), F.lit("episodic").alias("memory_type"), meta.alias("metadata"))


def line(with_vector: bool = False, columns: tuple[str, ...] = ("id", "memory_type", "content", "metadata", "agent_id", "session_id", "scope", "created_at", "accessed_at", "access_count", "importance", "ttl_secs")) -> Column:
    return F.to_json(F.struct(*columns, *(["vector"] if with_vector else [])))


def write_memories(mem: DataFrame, path: str, with_vector: bool = False) -> None:
    """One line for each row, written by all tasks into a folder."""
    mem.select(line(with_vector).alias("value")).write.text(path)


def parse_vector(text: str) -> list[float]:
    """A JSON array, or numbers parted by commas or white space."""
    text = text.strip()
    try:
        out = json.loads(text) if text.startswith("[") else [float(x) for x in text.replace(",", " ").split()]
        out = [float(x) for x in out]
    except (ValueError, TypeError):
        raise Invalid(f"not a vector: {text[:80]}") from None
    if not out:
        raise Invalid("empty vector")
    return out
