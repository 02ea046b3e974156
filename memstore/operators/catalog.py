"""Mutations as pure functions: old relations and changes in, the new relation out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memstore.operators import filters as P


def upsert(mem: DataFrame, incoming: DataFrame, now: int, key: str = "slot") -> DataFrame:
    """incoming (key, seq, some columns of mem): the highest seq of a key wins.

    A known key keeps its slot and access statistics and loses its tombstone; an unknown one
    is appended with defaults."""
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != key]), "seq").alias("__new"))
    fields = [c for c in incoming.columns if c in mem.columns and c != key]
    out = mem.withColumn("__old", F.lit(True)).join(last, key, "full_outer")
    is_new = F.col("__new").isNotNull()
    defaults = {
        "deleted": F.lit(False), "accessed_at": F.lit(now), "access_count": F.lit(0), "created_at": F.lit(now), "agent_id": F.lit("default"), "scope": F.lit("private"), "memory_type": F.lit("semantic"), "importance": F.lit(0.5),
    }
    for c in fields:
        out = out.withColumn(c, F.when(is_new, F.col(f"__new.{c}")).otherwise(F.col(c)))
    for c, d in defaults.items():
        if c in mem.columns:
            out = out.withColumn(c, F.when(F.col("__old").isNull() & (F.lit(c not in fields) | F.col(c).isNull()), d).otherwise(F.col(c)))
    if "deleted" in mem.columns:
        out = out.withColumn("deleted", F.when(is_new, F.lit(False)).otherwise(F.col("deleted")))
    return out.select(*mem.columns)


def delete(mem: DataFrame, keys: DataFrame, key: str = "slot") -> DataFrame:
    gone = keys.select(key).distinct().withColumn("__gone", F.lit(True))
    return mem.join(gone, key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def compact(mem: DataFrame, now: int) -> DataFrame:
    """Live rows that haven't expired, slots numbered anew in their order.

    The ranks are made range by range: rows are counted by slot range, so no window holds
    all rows in one task."""
    kept = mem.where(P.live() & ~P.expired(now))
    wide = kept.withColumn("__range", F.floor(F.col("slot") / RANGE))
    before = wide.groupBy("__range").count()
    before = before.withColumn("__before", F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("slot"))
    out = wide.withColumn("__rank", rank).join(before, "__range")
    return out.withColumn("new_slot", (F.coalesce("__before", F.lit(0)) + F.col("__rank") - 1).cast("long")).drop("__range", "__rank", "__before")


#: Slots of one range of compact().
RANGE = 1_000_000


def verify(mem: DataFrame, dimensions: int) -> DataFrame:
    """Reads every live row; a vector of another length raises."""
    sized = F.when(F.size("vector") == dimensions, F.lit(1)).otherwise(F.raise_error(F.format_string("record %s has %d dimensions", F.col("slot").cast("string"), F.size("vector"))).cast("int"))
    return mem.where(P.live()).agg(F.sum(sized.cast("long")).alias("verified"))


def session_turns(turns: DataFrame, session: str, key: str = "session_id") -> DataFrame:
    return turns.where(F.col(key) == session).orderBy("turn")


def consolidate(turns: DataFrame, session, key: str = "session_id") -> DataFrame:
    """The session's turns that are still working memory become episodic."""
    mine = (F.col(key) == session) & (F.col("memory_type") == "working")
    return turns.withColumn("memory_type", F.when(mine, F.lit("episodic")).otherwise(F.col("memory_type")))


def discard(turns: DataFrame, session, key: str = "session_id") -> DataFrame:
    """The relation without the session's turns."""
    return turns.where((F.col(key) != session) | F.col(key).isNull())


def stats(mem: DataFrame) -> DataFrame:
    """Live and deleted rows, and the live rows' agents, sorted and joined by commas."""
    agents = F.array_sort(F.collect_set(F.when(P.live(), F.col("agent_id"))))
    return mem.agg(F.count_if(P.live()).alias("live"), F.count_if(F.col("deleted")).alias("deleted"), F.array_join(agents, ",").alias("agents"))


def rollup(mem: DataFrame) -> DataFrame:
    """Extension: live rows and mean importance by agent and type, with subtotals."""
    return mem.where(P.live()).rollup("agent_id", "memory_type").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))
