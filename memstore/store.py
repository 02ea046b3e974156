"""A store on disk: immutable Parquet versions under a manifest for each transaction.

    store.json               dimensions, key derivation, wrapped key
    records/txn=N-*          bodies written by an attempt at transaction N
    catalog/txn=N-*          the whole catalog as of N: slot, version, tombstone, access statistics
    cache/txn=N-*            the whole result cache as of N
    index/txn=N-*            postings by partition, and the trained centres
    _manifest/N.json         the commit point, created exclusively, with a checksum of itself

Each attempt writes to folders of its own, so a writer that loses the race for a manifest
harms nothing: it keeps what it has pending, and `refresh` lets it try again.  Reads see a
transaction's files and what this handle has pending.  A crash before the manifest leaves
folders that nothing refers to; one within it leaves a torn manifest, which readers skip and
the next writer passes after TORN_SECONDS.
"""

from __future__ import annotations

import base64
import io
import json
import os
import time
import uuid
import zlib
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memstore import schema as M
from memstore.errors import Corrupt, Invalid, Locked, NotFound, ReadOnlyError, UnsupportedVersion, WrongPassphrase
from memstore.functions.text import ulid, ulid_column
from memstore.operators import ann, cache, catalog
from memstore.operators import recall as R
from memstore.sources import crypto, jsonl
from memstore.sources.files import Files

FORMAT, MAX_SNAPSHOTS = 1, 256
SEALED = ("content", "metadata")
#: Seconds after which a manifest that can't be read counts as torn, not as being written.
TORN_SECONDS = 60


class Store:
    """One handle on a store.  clock: unix seconds, a parameter so that results don't depend on the wall clock."""

    def __init__(self, spark: SparkSession, path: str, header: dict, key: bytes | None, read_only: bool, clock: Callable[[], int]):
        self.spark, self.path, self.header, self.key, self.read_only, self.clock = spark, path.rstrip("/"), header, key, read_only, clock
        self.files = Files(spark, self.path)
        self.max_snapshots, self.budgets, self.policy = MAX_SNAPSHOTS, {}, (1, None)
        self.hits = self.misses = self.evictions = 0
        self.manifest = self._newest()
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, dict] = {}
        self.marks: dict[str, bool] = {}
        self.touched: dict[str, tuple[int, int]] = {}
        self.cached: dict[tuple[str, str], dict | None] = {}
        self.index_change: object = None
        self.cache_since = None

    # -- opening ------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, passphrase: str | None = None, dimensions: int = M.DEFAULT_DIMENSIONS, clock: Callable[[], int] | None = None) -> Store:
        """A new, empty store; never over an existing one."""
        if dimensions <= 0:
            raise Invalid("dimensions must be positive")
        files = Files(spark, path)
        if files.exists("store.json"):
            raise Invalid(f"{path} holds a store already")
        header = {"format": FORMAT, "dimensions": dimensions, "created_at": int((clock or time.time)())}
        key = None
        if passphrase is not None:
            salt, key = os.urandom(16), os.urandom(32)
            header |= {"kdf": crypto.KDF, "salt": salt.hex(), "wrapped": _wrap(spark, key, crypto.derive_key(passphrase, salt))}
        files.write("store.json", json.dumps(header).encode(), exclusive=True)
        return cls(spark, path, header, key, False, clock or (lambda: int(time.time())))

    @classmethod
    def open(cls, spark: SparkSession, path: str, passphrase: str | None = None, dimensions: int | None = None, read_only: bool = False, clock: Callable[[], int] | None = None) -> Store:
        """An existing store, or a new one where dimensions are given."""
        files = Files(spark, path)
        if not files.exists("store.json"):
            if dimensions is None or read_only:
                raise NotFound(f"no store at {path}")
            return cls.create(spark, path, passphrase, dimensions, clock)
        header = files.read_json("store.json")
        if header.get("format") != FORMAT:
            raise UnsupportedVersion(str(header.get("format")))
        key = None
        if "wrapped" in header:
            key = _unwrap(spark, header["wrapped"], crypto.derive_key(passphrase or "", bytes.fromhex(header["salt"]), header["kdf"]))
            if key is None:
                raise WrongPassphrase("the passphrase doesn't open this store")
        return cls(spark, path, header, key, read_only, clock or (lambda: int(time.time())))

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names("_manifest") if n.endswith(".json")]

    def _manifest_of(self, name: str) -> dict | None:
        """A manifest, or None where it is torn: never committed."""
        try:
            out = self.files.read_json(f"_manifest/{name}")
            check = out.pop("crc32", None)
        except (ValueError, AttributeError):
            return None
        return out if check is None or check == _checksum(out) else None

    def _newest(self) -> dict:
        for name in reversed(self._manifests()):
            if (found := self._manifest_of(name)) is not None:
                return found
        return {"txn": 0, "created_at": 0, "records": [], "catalog": None, "cache": None, "index": None, "next_slot": 0, "count": 0}

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Flushes; on a read-only handle nothing."""
        if not self.read_only:
            self.flush()

    # -- relations ----------------------------------------------------------------

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _records(self) -> DataFrame:
        schema = M.T.StructType([*M.RECORDS.fields, M.T.StructField("version", M.T.LongType())])
        out = self._read(self.manifest["records"], schema)
        if self.key is not None:
            aad = F.concat_ws(":", "id", F.col("version").cast("string"))
            for c in SEALED:
                opened = crypto.open_sealed(F.col(c), self.key, aad)
                out = out.withColumn(c, F.when(F.col(c).isNotNull() & opened.isNull(), F.raise_error(F.concat(F.lit("sealed value was changed: "), F.col("id"))).cast("string")).otherwise(opened))
        return out

    def _catalog(self) -> DataFrame:
        return self._read([self.manifest["catalog"]] if self.manifest["catalog"] else [], M.CATALOG)

    def relation(self, slots: list[int] | None = None) -> DataFrame:
        """All memories, tombstones included, with this handle's pending changes.  slots: only
        those, a few; both scans get them as a filter, and records are written in slot order."""
        records, own = self._records(), self._catalog()
        if slots is not None:
            records, own = records.where(F.col("slot").isin(slots)), own.where(F.col("slot").isin(slots))
        out = R.memories(records, own).drop("version")
        if self.marks:
            rows = self.spark.createDataFrame(list(self.marks.items()), "id string, __d boolean")
            out = out.join(F.broadcast(rows), "id", "left").withColumn("deleted", F.coalesce("__d", "deleted")).drop("__d")
        if self.touched:
            rows = self.spark.createDataFrame([(i, n, t) for i, (n, t) in self.touched.items()], "id string, __n long, __t long")
            out = out.join(F.broadcast(rows), "id", "left").withColumn("accessed_at", F.coalesce("__t", "accessed_at"))
            out = out.withColumn("access_count", F.least(F.col("access_count") + F.coalesce("__n", F.lit(0)), F.lit(M.MAX_COUNT))).drop("__n", "__t")
        if self.rows:
            new = self.spark.createDataFrame(list(self.rows.values()), M.T.StructType([*M.RECORDS.fields, *M.CATALOG.fields[3:]]))
            out = out.join(F.broadcast(new.select("id")), "id", "left_anti").unionByName(new.select(*out.columns))
        return out

    @property
    def dimensions(self) -> int:
        return self.header["dimensions"]

    def __len__(self) -> int:
        return self.relation().where("not deleted").count()

    def is_empty(self) -> bool:
        return len(self) == 0

    # -- memories -----------------------------------------------------------------

    def _write(self) -> None:
        if self.read_only:
            raise ReadOnlyError("this handle is read-only")

    def _find(self, id: str) -> dict | None:
        if id in self.rows:
            return self.rows[id]
        row = self.relation().where(F.col("id") == id).first()
        return row.asDict(True) if row else None

    def remember(
        self, content: str, memory_type: str, vector, *, importance: float = M.DEFAULT_IMPORTANCE, agent_id: str = M.DEFAULT_AGENT, session_id: str | None = None,
        ttl_secs: int | None = None, shared: bool = False, metadata: dict | None = None, id: str | None = None, created_at: int | None = None,
    ) -> str:
        """Stages a memory; an id that is known is overwritten and keeps slot and access statistics."""
        self._write()
        now, old = self.clock(), self._find(id) if id else None
        row = {
            "id": id or ulid(now * 1000 + len(self.rows) % 1000), "memory_type": M.memory_type(memory_type), "vector": M.check_vector(vector, self.dimensions), "content": content,
            "metadata": json.dumps(metadata or {}), "agent_id": agent_id, "session_id": session_id, "scope": "shared" if shared else "private", "created_at": now if created_at is None else created_at,
            "importance": min(max(float(importance), 0.0), 1.0), "ttl_secs": ttl_secs, "deleted": False,
            "slot": old["slot"] if old else self.manifest["next_slot"] + sum(r["slot"] >= self.manifest["next_slot"] for r in self.rows.values()),
            "accessed_at": old["accessed_at"] if old else now, "access_count": old["access_count"] if old else 0,
        }
        self.rows[row["id"]] = row
        self.marks.pop(row["id"], None)
        return row["id"]

    def remember_frame(self, rows: DataFrame) -> int:
        """Bulk upsert in one transaction: content, vector and any other record columns.

        A known id is overwritten and keeps slot and access statistics; of an id that repeats
        among the rows the last one counts.  New slots follow the partitions' order: rows are
        written once, counted by partition, and numbered within each, so no task sees all rows."""
        self._write()
        self.flush()
        now, txn = self.clock(), self.manifest["txn"] + 1
        have = set(rows.columns)
        default = {"memory_type": F.lit("semantic"), "agent_id": F.lit(M.DEFAULT_AGENT), "scope": F.lit("private"), "importance": F.lit(M.DEFAULT_IMPORTANCE), "created_at": F.lit(now), "metadata": F.lit("{}"), "session_id": F.lit(None), "ttl_secs": F.lit(None)}
        sized = F.when(F.size("vector") == self.dimensions, F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector hasn't {self.dimensions} dimensions")).cast("array<float>"))
        body = rows.select(
            (F.coalesce(F.col("id"), ulid_column(now * 1000)) if "id" in have else ulid_column(now * 1000)).alias("id"), sized.alias("vector"), "content",
            *[(F.greatest(F.col(c).cast("long"), F.lit(0)) if c in have else F.lit(None).cast("long")).alias(c) for c in ("accessed_at", "access_count")],
            *[(F.coalesce(F.col(c), d) if c in have else d).cast(M.RECORDS[c].dataType).alias(c) for c, d in default.items()], F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"),
        )
        tag = _tag(txn)
        staged = f"{self.path}/staged/{tag}"
        body.write.parquet(staged)
        body = self.spark.read.parquet(staged)
        if "id" in have:
            last = body.groupBy("id").agg(F.max(F.struct("__p", "__m")).alias("__l"))
            body = body.join(last, "id").where((F.col("__p") == F.col("__l.__p")) & (F.col("__m") == F.col("__l.__m"))).drop("__l")
        known = self._catalog().select("id", "slot", F.col("accessed_at").alias("__t"), F.col("access_count").alias("__n"))
        old = body.join(known, "id").withColumn("accessed_at", F.col("__t")).withColumn("access_count", F.col("__n")) if "id" in have else None
        body = body.join(known, "id", "left_anti") if "id" in have else body
        body = body.withColumn("accessed_at", F.coalesce("accessed_at", F.lit(now))).withColumn("access_count", F.coalesce("access_count", F.lit(0)))
        sizes = {r["__p"]: r["count"] for r in body.groupBy("__p").count().collect()}
        start, at = {}, self.manifest["next_slot"]
        for p in sorted(sizes):
            start[p], at = at, at + sizes[p]
        first = self.spark.createDataFrame(list(start.items()) or [(0, 0)], "__p int, __s long")
        rank = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
        numbered = body.withColumn("__r", rank).join(F.broadcast(first), "__p").withColumn("slot", F.col("__s") + F.col("__r") - 1)
        columns = [*[f.name for f in M.RECORDS], "accessed_at", "access_count"]
        written = numbered.select(*columns) if old is None else numbered.select(*columns).unionByName(old.select(*columns))
        self._seal(written.withColumn("version", F.lit(txn).cast("long"))).write.parquet(f"{self.path}/records/{tag}")
        fresh = self.spark.read.parquet(f"{self.path}/records/{tag}").select("id", "slot", "version", F.lit(False).alias("deleted"), "accessed_at", "access_count")
        before = self._catalog()
        before = before if old is None else before.join(fresh.select("id"), "id", "left_anti").select(*before.columns)
        before.unionByName(fresh).write.parquet(f"{self.path}/catalog/{tag}")
        n = fresh.count()
        self.files.delete(f"staged/{tag}")
        new = dict(self.manifest) | {"records": [*self.manifest["records"], f"records/{tag}"], "catalog": f"catalog/{tag}", "next_slot": at}
        if new["index"]:
            self._commit(new | {"index": None})
            self._follow(old_index=new["index"])
        else:
            self._commit(new)
        return n

    def _follow(self, old_index: str) -> None:
        """Codes of all live rows under an index's centres, as a transaction."""
        index = self._index(old_index)
        self._commit(self.manifest | {"index": self._save_index(index, _tag(self.manifest["txn"] + 1))})

    def import_jsonl(self, path: str) -> int:
        """All lines of a file as one transaction; a bad line fails the whole import and is named by its number."""
        if (bad := jsonl.first_bad_line(self.spark, path)) is not None:
            raise Invalid(f"bad line {bad[0]}: {bad[1]}")
        return self.remember_frame(jsonl.read_memories(self.spark, path))

    def export_jsonl(self, path: str, with_vector: bool = False) -> None:
        jsonl.write_memories(self.memories(), path, with_vector)

    def export_sealed(self, path: str, passphrase: str) -> None:
        """Lines with vectors, each sealed under a key derived from the passphrase; salt and parameters lie beside them."""
        salt = os.urandom(16)
        key = crypto.derive_key(passphrase, salt)
        self.memories().select(F.regexp_replace(crypto.seal(jsonl.line(True), key, F.lit("export")), "\\s", "").alias("value")).write.text(f"{path.rstrip('/')}/lines")
        Files(self.spark, path).write("export.json", json.dumps({"format": FORMAT, "kdf": crypto.KDF, "salt": salt.hex()}).encode())

    def import_sealed(self, path: str, passphrase: str) -> int:
        """What export_sealed wrote; a wrong passphrase or a changed line fails the whole import."""
        header = Files(self.spark, path).read_json("export.json")
        key = crypto.derive_key(passphrase, bytes.fromhex(header["salt"]), header["kdf"])
        sealed = self.spark.read.text(f"{path.rstrip('/')}/lines")
        opened = crypto.open_sealed(F.col("value"), key, F.lit("export"))
        if sealed.where(opened.isNull()).limit(1).count():
            raise WrongPassphrase("the passphrase doesn't open this export, or a line was changed")
        return self.remember_frame(jsonl.memories_of(sealed.select(opened.alias("value"))))

    def get(self, id: str) -> dict:
        row = self._find(id)
        if row is None or row["deleted"]:
            raise NotFound(id)
        return row

    def delete(self, id: str) -> None:
        """Tombstones; NotFound only for an id never seen."""
        self._write()
        if id in self.rows:
            self.rows[id]["deleted"] = True
        elif self._find(id) is None:
            raise NotFound(id)
        else:
            self.marks[id] = True

    def memories(self) -> DataFrame:
        return R.scan_live(self.relation()).orderBy("slot")

    def listing(self, **options) -> DataFrame:
        return R.listing(self.relation(), **options)

    def about(self, manifest_only: bool = False) -> DataFrame:
        return R.about(self.relation(), manifest_only)

    def insert_default_manifest(self, name: str = "memory store") -> str:
        """A shared onboarding memory that says what the store is; to be replaced by its owner."""
        meta = {"area": "onboarding", "topic": "manifest", "scaffold": True, "dimensions": self.dimensions, "format": FORMAT}
        text = f"{name}: replace this text by what a reader of the memories should know first. Vectors have {self.dimensions} dimensions; embed with one model throughout and name it and its version here."
        return self.remember(text, "semantic", [0.0] * self.dimensions, importance=1.0, shared=True, metadata=meta)

    def search(self, query, top_k: int = 5, metric: str = "cosine") -> DataFrame:
        return R.search(self.relation(), M.check_vector(query, self.dimensions), top_k, self.clock(), metric)

    def recall(self, request: R.Request) -> list[dict]:
        """Ranked rows; with track_access their statistics are bumped and come back bumped."""
        M.check_vector(request.query, self.dimensions)
        if request.track_access:
            self._write()
        now, found = self.clock(), None
        if self.manifest["index"] and self.index_change is None:
            index = self._index()
            found = ann.candidates(self._postings(), index, request.query, request.n_probe, request.n_rerank)
            if self.rows:  # pending rows aren't in the postings yet
                extra = self.spark.createDataFrame([(r["slot"], 1 << 30) for r in self.rows.values()], "slot long, rank int")
                found = found.unionByName(extra).groupBy("slot").agg(F.min("rank").alias("rank"))
        slots = None if found is None else [r["slot"] for r in found.collect()]  # n_rerank and the pending rows
        hits = [r.asDict(True) for r in R.recall(self.relation(slots), request, now, found).collect()]
        if request.track_access:
            for h in hits:
                n, _ = self.touched.get(h["id"], (0, 0))
                h["accessed_at"], h["access_count"] = now, min(h["access_count"] + 1, M.MAX_COUNT)
                if h["id"] in self.rows:
                    self.rows[h["id"]] |= {"accessed_at": now, "access_count": h["access_count"]}
                else:
                    self.touched[h["id"]] = (n + 1, now)
        return hits

    # -- index --------------------------------------------------------------------

    def build_index(self, partitions: int | None = None, subspaces: int | None = None, n_probe: int = ann.N_PROBE, n_rerank: int = ann.N_RERANK) -> None:
        """Over all live rows, expired included; part of the next flush."""
        self._write()
        self.index_change = (partitions, subspaces, n_probe, n_rerank)
        self.flush()

    def rebuild_index(self) -> None:
        info = self._index() if self.manifest["index"] else None
        self.build_index(n_probe=info.n_probe if info else ann.N_PROBE, n_rerank=info.n_rerank if info else ann.N_RERANK)

    def drop_index(self) -> None:
        if not self.read_only and self.has_index():
            self.index_change = False
            self.flush()

    def has_index(self) -> bool:
        return bool(self.manifest["index"])

    def _index(self, name: str | None = None) -> ann.Index:
        z = np.load(io.BytesIO(self.files.read(f"{name or self.manifest['index']}/_centres.npz")))
        return ann.Index(z["centres"], [z[f"book{i}"] for i in range(int(z["books"]))], int(z["n_probe"]), int(z["n_rerank"]))

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("slot long, code binary, part int").parquet(f"{self.path}/{self.manifest['index']}/postings")

    def index_info(self) -> dict | None:
        return ann.info(self._postings(), self._index()).first().asDict() if self.has_index() else None

    def _save_index(self, index: ann.Index, tag: str) -> str:
        name = f"index/{tag}"
        ann.write_postings(ann.encode(self.relation(), index), f"{self.path}/{name}/postings")
        out = io.BytesIO()
        np.savez(out, centres=index.centres, books=len(index.codebooks), n_probe=index.n_probe, n_rerank=index.n_rerank, **{f"book{i}": b for i, b in enumerate(index.codebooks)})
        self.files.write(f"{name}/_centres.npz", out.getvalue())
        return name

    # -- transactions ---------------------------------------------------------------

    def _seal(self, rows: DataFrame) -> DataFrame:
        if self.key is not None:
            aad = F.concat_ws(":", "id", F.col("version").cast("string"))
            for c in SEALED:
                rows = rows.withColumn(c, crypto.seal(F.col(c), self.key, aad))
        return rows

    def _free(self) -> int:
        """The number of the next transaction: past manifests that a crash has torn."""
        txn, have = self.manifest["txn"] + 1, set(self._manifests())
        while (name := f"{txn:012d}.json") in have:
            if self._manifest_of(name) is not None or self.files.age(f"_manifest/{name}") < TORN_SECONDS:
                raise Locked(f"transaction {txn} was committed by another writer, or is being committed")
            txn += 1
        return txn

    def _commit(self, manifest: dict) -> None:
        txn = self._free()
        manifest = manifest | {"txn": txn, "created_at": self.clock()}
        old, self.manifest = self.manifest, manifest
        manifest["count"] = self._catalog().where("not deleted").count()
        try:
            self.files.write(f"_manifest/{txn:012d}.json", json.dumps(manifest | {"crc32": _checksum(manifest)}).encode(), exclusive=True)
        except Exception:
            self.manifest = old
            raise
        self._prune()

    def _prune(self) -> None:
        names = self._manifests()
        if self.max_snapshots and len(names) > self.max_snapshots:
            self._drop(names[: -self.max_snapshots])

    def _drop(self, names: list[str]) -> None:
        """Deletes snapshots, and the folders that only they refer to."""
        gone = set().union(*(_folders(self._manifest_of(n)) for n in names))
        for n in names:
            self.files.delete(f"_manifest/{n}")
        for folder in gone.difference(*(_folders(self._manifest_of(n)) for n in self._manifests())):
            self.files.delete(folder)

    def refresh(self) -> None:
        """Goes on from the newest transaction, with what this handle has pending: after Locked, flush can be tried again.

        Pending memories of ids that are known by now take over slot and statistics; others get new slots."""
        self.manifest = self._newest()
        at, pending = self.manifest["next_slot"], self.rows
        if not pending:
            return
        self.rows = {}
        known = {r["id"]: r for r in self.relation().where(F.col("id").isin(list(pending))).select("id", "slot", "accessed_at", "access_count").collect()}
        for key, row in pending.items():
            if key in known:
                row |= {k: known[key][k] for k in ("slot", "accessed_at", "access_count")}
            else:
                row["slot"], at = at, at + 1
        self.rows = pending

    def set_max_snapshots(self, n: int) -> None:
        self.max_snapshots = n

    def flush(self) -> None:
        """One transaction of all that is pending; nothing where nothing is."""
        self._write()
        dirty = self.rows or self.marks or self.touched
        if not (dirty or self.cached or self.index_change is not None):
            return
        txn, new = self.manifest["txn"] + 1, dict(self.manifest)
        tag = _tag(txn)
        if dirty:
            rel = self.relation()
            if self.rows:
                schema = M.T.StructType([*M.RECORDS.fields, *M.CATALOG.fields[3:]])
                rows = self.spark.createDataFrame(list(self.rows.values()), schema).withColumn("version", F.lit(txn).cast("long"))
                self._seal(rows).select(*[f.name for f in M.RECORDS], "version").coalesce(1).write.parquet(f"{self.path}/records/{tag}")
                new["records"] = [*new["records"], f"records/{tag}"]
                new["next_slot"] = max(new["next_slot"], 1 + max(r["slot"] for r in self.rows.values()))
            fresh = F.col("id").isin(list(self.rows)) if len(self.rows) <= 1000 else F.lit(False)
            versions = self._catalog().select("id", "version")
            merged = rel.select("id", "slot", "deleted", "accessed_at", "access_count").join(versions, "id", "left")
            if len(self.rows) > 1000:
                mine = F.broadcast(self.spark.createDataFrame([(i, True) for i in self.rows], "id string, __f boolean"))
                merged, fresh = merged.join(mine, "id", "left"), F.coalesce(F.col("__f"), F.lit(False))
            merged = merged.withColumn("version", F.when(fresh, F.lit(txn)).otherwise(F.col("version")).cast("long"))
            merged.select(*[f.name for f in M.CATALOG]).write.parquet(f"{self.path}/catalog/{tag}")
            new["catalog"] = f"catalog/{tag}"
        if self.cached:
            self._cache_rows().write.parquet(f"{self.path}/cache/{tag}")
            new["cache"] = f"cache/{tag}"
        if self.index_change is False:
            new["index"] = None
        elif self.index_change is not None:
            new["index"] = self._save_index(ann.train(self.relation(), *self.index_change), tag)
        elif new["index"] and (self.rows or self.marks):
            new["index"] = self._save_index(self._index(), tag)  # centres stay, codes follow
        self._commit(new)  # Locked leaves all that is pending as it was
        self._reset()

    def snapshots(self) -> list[dict]:
        out = [self._manifest_of(n) for n in self._manifests()]
        return [{"txn_id": m["txn"], "created_at": m["created_at"], "memory_count": m["count"]} for m in out if m is not None]

    def restore_to(self, txn: int) -> None:
        """Makes an old state the newest transaction; the result cache stays as it is."""
        self._write()
        if self.rows or self.marks or self.touched:
            raise Invalid("flush or drop pending changes before a restore")
        name = f"{txn:012d}.json"
        if not self.files.exists(f"_manifest/{name}") or (old := self._manifest_of(name)) is None:
            raise NotFound(f"snapshot {txn}")
        self._commit(self.manifest | {k: old[k] for k in ("records", "catalog", "index")})

    def restore_to_time(self, t: int) -> int:
        """The highest transaction made at or before t."""
        fit = [s["txn_id"] for s in self.snapshots() if s["created_at"] <= t]
        if not fit:
            raise NotFound(f"no snapshot at or before {t}")
        self.restore_to(max(fit))
        return max(fit)

    def compact(self) -> dict:
        """Rewrites live, unexpired rows with new slots, keeps live cache entries, and leaves one snapshot."""
        self._write()
        self.flush()
        before, now, txn = self.relation().count(), self.clock(), self.manifest["txn"] + 1
        kept = catalog.compact(self.relation(), now).withColumn("slot", F.col("new_slot")).withColumn("version", F.lit(txn).cast("long"))
        index, tag = self._index() if self.has_index() else None, _tag(txn)
        self._seal(kept).select(*[f.name for f in M.RECORDS], "version", "deleted", "accessed_at", "access_count").write.parquet(f"{self.path}/records/{tag}")
        self.spark.read.parquet(f"{self.path}/records/{tag}").select(*[f.name for f in M.CATALOG]).write.parquet(f"{self.path}/catalog/{tag}")
        n = self.spark.read.parquet(f"{self.path}/catalog/{tag}").count()
        self._commit(self.manifest | {"records": [f"records/{tag}"], "catalog": f"catalog/{tag}", "index": None, "next_slot": n})
        if index is not None and n:
            self.build_index(n_probe=index.n_probe, n_rerank=index.n_rerank)
        self._drop(self._manifests()[:-1])
        return {"before": before, "after": n}

    def verify(self) -> int:
        got = catalog.verify(self.relation(), self.dimensions).first()[0]
        if got is None:
            return 0
        if got != len(self):
            raise Corrupt("records are missing")
        return got

    def rekey(self, passphrase: str) -> None:
        self._write()
        if self.key is None:
            raise Invalid("this store isn't sealed")
        salt = os.urandom(16)
        self.header |= {"salt": salt.hex(), "wrapped": _wrap(self.spark, self.key, crypto.derive_key(passphrase, salt))}
        self.files.write("store.json", json.dumps(self.header).encode())

    def stats(self) -> dict:
        row = catalog.stats(self.relation()).first()
        return {"live": row["live"], "deleted": row["deleted"], "agents": row["agents"].split(",") if row["agents"] else [], "dimensions": self.dimensions, "created_at": self.header["created_at"], "snapshots": len(self.snapshots()), "sealed": self.key is not None, "indexed": self.has_index()}

    def set_cache_capacity(self, _pages: int) -> None:
        """Accepted and ignored: Spark's block manager does the caching."""

    # -- result cache -----------------------------------------------------------------

    def _cache_rows(self) -> DataFrame:
        out = self._read([self.manifest["cache"]] if self.manifest["cache"] else [], M.CACHE)
        if self.cached:
            gone = self.spark.createDataFrame(list(self.cached), "namespace string, key_hash string")
            out = out.join(F.broadcast(gone), ["namespace", "key_hash"], "left_anti").select(*[f.name for f in M.CACHE])
            rows = [r for r in self.cached.values() if r]
            if rows:
                out = out.unionByName(self.spark.createDataFrame(rows, M.CACHE))
        return out

    def _cache_find(self, namespace: str, key: str) -> dict | None:
        import hashlib

        at = (namespace, hashlib.sha256(key.encode()).hexdigest())
        if at in self.cached:
            return self.cached[at]
        row = self._cache_rows().where((F.col("namespace") == namespace) & (F.col("key_hash") == at[1])).first()
        return row.asDict() if row else None

    def _cache_changed(self) -> None:
        self.cache_since = self.cache_since or self.clock()
        most, age = self.policy
        if len(self.cached) >= most or (age is not None and self.clock() - self.cache_since >= age):
            self.flush()

    def set_flush_policy(self, max_dirty: int = 1, max_age: int | None = None) -> None:
        """1: every cache write is a transaction; else a batch of max_dirty writes or max_age seconds."""
        self.policy = (max_dirty, max_age)

    def set_budget(self, namespace: str, entries: int = cache.MAX_ENTRIES, size: int = cache.MAX_BYTES) -> None:
        self.budgets[namespace] = (entries, size)

    def cache_put(self, namespace: str, key: str, value: bytes, content_type: str | None = None, ttl_secs: int | None = None, cost_hint_ms: int | None = None, vector=None, model: str | None = None) -> None:
        import hashlib

        self._write()
        now = self.clock()
        row = {
            "pos": int(now * 1_000_000) + len(self.cached), "namespace": namespace, "key_hash": hashlib.sha256(key.encode()).hexdigest(), "key_preview": key if len(key) <= 120 else key[:119] + "…", "value": bytearray(value),
            "content_type": content_type, "created_at": now, "accessed_at": now, "access_count": 0, "ttl_secs": ttl_secs, "cost_hint_ms": cost_hint_ms, "size_bytes": len(value), "vector": vector, "model": model, "deleted": False,
        }
        top = self._cache_rows().agg(F.max("pos")).first()[0]
        row["pos"] = 0 if top is None else top + 1
        self.cached[namespace, row["key_hash"]] = row
        entries, size = self.budgets.get(namespace, (cache.MAX_ENTRIES, cache.MAX_BYTES))
        mine = self._cache_rows().where(F.col("namespace") == namespace)
        use = mine.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b")).first()
        if use["n"] > entries or (use["b"] or 0) > size:
            left = cache.within_budget(mine, entries, size)
            others = self._cache_rows().where(F.col("namespace") != namespace)
            self.evictions += self._cache_replace(others.unionByName(left.select(*others.columns)))
            return
        self._cache_changed()

    def cache_put_semantic(self, namespace: str, key: str, vector, value: bytes, model: str, **options) -> None:
        self.cache_put(namespace, key, value, vector=M.check_vector(vector, self.dimensions), model=model, **options)

    def _hit(self, row: dict | None) -> dict | None:
        now = self.clock()
        if row is None or (row["ttl_secs"] is not None and max(now - row["created_at"], 0) >= row["ttl_secs"]):
            self.misses += 1
            return None
        self.hits += 1
        if not self.read_only:
            row = row | {"accessed_at": now, "access_count": row["access_count"] + 1}
            self.cached[row["namespace"], row["key_hash"]] = row
        return row | {"value": bytes(row["value"])}

    def cache_get(self, namespace: str, key: str) -> dict | None:
        return self._hit(self._cache_find(namespace, key))

    def cache_get_semantic(self, namespace: str, query, model: str, threshold: float = cache.THRESHOLD) -> dict | None:
        found = cache.semantic(self._cache_rows(), namespace, M.check_vector(query, self.dimensions), model, self.clock(), threshold).first()
        if found is None:
            return self._hit(None)
        row = found.asDict()
        sim = row.pop("similarity")
        return self._hit(row) | {"similarity": sim}

    def cache_delete(self, namespace: str, key: str) -> None:
        self._write()
        row = self._cache_find(namespace, key)
        if row:
            self.cached[namespace, row["key_hash"]] = None
            self._cache_changed()

    def cache_purge(self, namespace: str | None = None, expired_only: bool = False) -> int:
        self._write()
        rows = self._cache_rows()
        gone = cache.purged(rows, self.clock(), namespace, expired_only).select("namespace", "key_hash")
        if not gone.limit(1).count():
            return 0
        return self._cache_replace(rows.join(gone, ["namespace", "key_hash"], "left_anti").select(*rows.columns))

    def _cache_replace(self, rows: DataFrame) -> int:
        """Makes `rows` the result cache, as a transaction; returns how many entries are gone."""
        tag, before = _tag(self.manifest["txn"] + 1), self._cache_rows().count()
        rows.write.parquet(f"{self.path}/cache/{tag}")
        self._commit(self.manifest | {"cache": f"cache/{tag}"})
        self.cached, self.cache_since = {}, None
        return before - self._cache_rows().count()

    def cache_stats(self, namespace: str | None = None) -> dict:
        row = cache.stats(self._cache_rows(), namespace).agg(F.sum("entries").alias("e"), F.sum("bytes").alias("b")).first()
        asked = self.hits + self.misses
        return {"entries": row["e"] or 0, "bytes": row["b"] or 0, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0}

    def cached_call(self, namespace: str, ttl_secs: int | None = None):
        """Decorator: results of a function of JSON arguments, kept in the cache."""

        def wrap(f):
            @wraps(f)
            def call(*args, **kwargs):
                key = json.dumps([f.__name__, args, kwargs], sort_keys=True)
                if hit := self.cache_get(namespace, key):
                    return json.loads(hit["value"])
                out = f(*args, **kwargs)
                self.cache_put(namespace, key, json.dumps(out).encode(), "application/json", ttl_secs)
                return out

            return call

        return wrap

    # -- sessions ---------------------------------------------------------------------

    def session(self, agent_id: str, session_id: str | None = None):
        from memstore.session import Session

        return Session(self, agent_id, session_id or ulid())


def _tag(txn: int) -> str:
    """The name of the folders of one attempt at a transaction."""
    return f"txn={txn}-{uuid.uuid4().hex[:12]}"


def _checksum(manifest: dict) -> int:
    return zlib.crc32(json.dumps(manifest, sort_keys=True).encode())


def _folders(manifest: dict | None) -> set[str]:
    """The folders that a manifest refers to."""
    return set() if manifest is None else {f for f in (*manifest["records"], manifest["catalog"], manifest["cache"], manifest["index"]) if f}


def request(**options) -> R.Request:
    return replace(R.Request(), **options)


def described(r: R.Request) -> dict:
    return asdict(r)


def _wrap(spark: SparkSession, key: bytes, outer: bytes) -> str:
    return spark.range(1).select(crypto.seal(F.lit(base64.b64encode(key).decode()), outer, F.lit("data key"))).first()[0]


def _unwrap(spark: SparkSession, wrapped: str, outer: bytes) -> bytes | None:
    got = spark.range(1).select(crypto.open_sealed(F.lit(wrapped), outer, F.lit("data key"))).first()[0]
    return base64.b64decode(got) if got else None
