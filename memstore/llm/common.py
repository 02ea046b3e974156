"""Shared plumbing: scratch tables, row keys, connected components, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Session-unique prefix of internal columns; input columns of any other name never clash.
KEY = "__key"

#: White space of the word contracts: space and 0x09-0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: How scratch tables are written: shuffle files go when the execution that made them ends, as
#: nothing reads them again, and rows reach Python in small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.  Where that is unset: the warehouse on a cluster, a temporary folder on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="memstore-scratch-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage durably.  Those no longer needed are
    dropped early, the rest when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made, self.live = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0, {}
        self._files(self.root)[0].deleteOnExit(self._files(self.root)[1])

    def table(self, df: DataFrame, name: str, pinned: bool = False) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        before = {k: self.spark.conf.get(k) for k in WRITING}
        try:
            for k, v in WRITING.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(T.StructType.fromJson(df.schema.jsonValue())).parquet(path)
        out._scratch_path = path
        self.live[path] = pinned
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and drops every table before it that isn't pinned."""
        out = self.table(df, name)
        for path in [p for p, pinned in self.live.items() if not pinned and p != out._scratch_path]:
            self._delete(path)
        return out

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, name: str) -> None:
        files, path = self._files(name)
        files.delete(path, True)
        self.live.pop(name, None)


def give_back() -> None:
    """Returns free memory of Arrow and of the C library, where it can, and the tables of powers to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_heap(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, as many as get one of these tasks; a heap that
    one stage has grown is given back, and doesn't stand beside the Python workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def tidy(run):
    """A function of Arrow batches that gives freed memory back to the system when its task
    ends: Python workers live on, and what one stage needed mustn't count against the next."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def quoted(names) -> list:
    """Columns by name, whatever characters the names hold."""
    return [F.col(f"`{n}`") for n in names]


def numbered(names) -> list:
    """Columns by name, under names that mapInArrow can look up whatever the first ones hold."""
    return [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]


def kept_columns(keep, made) -> list[str]:
    """The names of `keep`, each once, without those that the operator makes itself: its own column stays."""
    return [c for c in dict.fromkeys(keep) if c not in made]


def fields(schema: T.StructType, names) -> list[str]:
    """DDL of some columns."""
    return [f"`{n}` {schema[n].dataType.simpleString()}" for n in names]


def keyed(df: DataFrame, id_col: str, columns: list[str], scratch: Scratch) -> DataFrame:
    """`columns` and id_col plus KEY, a long that is unique per row and never null.

    Where ids are unique and not null they are the key themselves (checked by an
    aggregation over the ids alone).  Else rows are numbered, and the numbered rows are
    written out so that a recomputed task can't number them differently.
    """
    df = df.select(*quoted([id_col, *columns]))
    whole = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType))
    own = F.col(f"`{id_col}`")
    odd = df.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where(F.col("id").isNull() | (F.col("n") > 1))
    if whole and not odd.limit(1).count():
        return df.withColumn(KEY, own.cast("long"))
    return scratch.table(df.withColumn(KEY, F.monotonically_increasing_id()), "keyed", pinned=True)


#: Edges up to which one task finds all components (32 MB of edges); beyond, star steps do.
SMALL_EDGES = 2_000_000


#: New edges that a task gathers, at least, before it shrinks them.
COMPACT = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, sorted, and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            return nodes, nodes[low]


def _forests(batches):
    """One forest for all edges of a partition, gathered so that memory stays bounded by its distinct nodes."""
    u = v = np.zeros(0, np.int64)
    some, held, limit = [], 0, COMPACT
    for batch in batches:
        some.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        held += batch.num_rows
        if held > limit:  # twice what the last forest left, so that all sorting together stays near linear
            u, v = forest(np.concatenate([u, *(s[0] for s in some)]), np.concatenate([v, *(s[1] for s in some)]))
            some, held, limit = [], 0, max(COMPACT, len(u))
    u, v = np.concatenate([u, *(s[0] for s in some)]), np.concatenate([v, *(s[1] for s in some)])
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", small: int = SMALL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    Each partition first shrinks its edges to a forest.  Up to `small` remaining edges, one
    task finds the components; their number is counted first.  Beyond, large-star and
    small-star steps alternate (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): both aggregate minima map-side and join back, so a node of any degree is
    split by skew joins, and no neighbour list is ever collected.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = scratch.table(e.mapInArrow(tidy(_forests), "u long, v long").where("u <> v"), "edges")
    if e.count() <= small:
        return scratch.table(e.coalesce(1).mapInArrow(tidy(_forests), "u long, v long").toDF("node", "component"), "components")
    last = None
    while True:
        # large star: neighbours above u point to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e1 = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u itself, point to the least of them
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.table(e2.where("u <> v").distinct(), "edges")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if sign == last:
            break
        last = sign
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, column: int, limit: int):
    """The batch in slices whose text in `column` stays under `limit` bytes (a longer row is alone)."""
    _, off = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.ones(size, np.uint64)
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            _powers[name] = p
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """pre[i]: sum of code(byte j) * BASE**j for j < i, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=pre[1:])
    return pre


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes start..end that doesn't depend on where they stand."""
    _, down = powers(len(pre))
    return mix64((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def held_out(column, modulus: int, remainder: int):
    """crc32 of the id as text, modulo `modulus`, equals `remainder` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
