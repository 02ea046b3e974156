"""One query for each operator, over the derived relations, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memstore.functions import scoring as S
from memstore.functions import text as X
from memstore.functions import vectors as V
from memstore.operators import ann, cache, catalog, snapshots
from memstore.operators import filters as P
from memstore.operators import recall as R
from memstore.plans.fixtures import NOW, relation, sql
from memstore.sources import crypto, jsonl
from memstore.sources.files import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"


def _cos(a: str, b: str) -> str:
    na, nb = _DOT.format(a, a), _DOT.format(b, b)
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN CAST(0 AS DOUBLE) ELSE {_DOT.format(a, b)} / (sqrt({na}) * sqrt({nb})) END"


def query(names: str, oracle: str | None = None):
    """Registers f(*relations) under its name; `names` are the relations, `oracle` the DuckDB text over them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[relation(spark, sf_dir, n) for n in names.split()])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = sql(names, oracle)
        return f

    return add


def first_vector(mem: DataFrame, slot: int = 0) -> list[float]:
    return mem.where(F.col("slot") == slot).select("vector").first()[0]


LIVE = "NOT deleted"
UNEXPIRED = f"(ttl_secs IS NULL OR {NOW} - created_at < ttl_secs)"


@query("mem", f"SELECT slot, memory_type, agent_id, content FROM mem WHERE {LIVE}")
def scan_live(mem):
    return R.scan_live(mem).select("slot", "memory_type", "agent_id", "content")


@query("mem", f"SELECT slot, content, created_at FROM mem WHERE slot IN (0, 33) AND {LIVE}")
def get_by_id(mem):
    # 0 is expired and found all the same, 33 is deleted
    return R.get(mem, "slot", 0).unionByName(R.get(mem, "slot", 33)).select("slot", "content", "created_at")


@query("mem", "SELECT slot AS id, content, accessed_at, access_count, deleted FROM mem")
def record_catalog_join(mem):
    records = mem.select(F.col("slot").alias("id"), "content", "slot", "deleted", F.lit(0).alias("accessed_at"), F.lit(0).alias("access_count"))
    owned = mem.select(F.col("slot").alias("id"), "slot", "deleted", "accessed_at", "access_count")
    return R.memories(records, owned).select("id", "content", "accessed_at", "access_count", "deleted")


@query("mem", f"SELECT count(*) AS n FROM mem WHERE {LIVE}")
def live_count(mem):
    return R.scan_live(mem).agg(F.count("*").alias("n"))


@query("mem", f"SELECT slot, ttl_secs FROM mem WHERE NOT {UNEXPIRED}")
def ttl_filter(mem):
    return mem.where(P.expired(NOW)).select("slot", "ttl_secs")


@query("mem", "SELECT slot, memory_type FROM mem WHERE memory_type IN ('semantic', 'working')")
def type_filter(mem):
    return mem.where(P.of_types(["semantic", "working"])).select("slot", "memory_type")


@query("mem", "SELECT slot, agent_id, scope FROM mem WHERE agent_id = 'agent-1' OR scope = 'shared'")
def agent_scope(mem):
    return mem.where(P.visible_to("agent-1")).select("slot", "agent_id", "scope")


@query("mem", f"SELECT slot, created_at FROM mem WHERE {LIVE} ORDER BY created_at, slot LIMIT 50")
def list_created(mem):
    return R.listing(mem, "created", limit=50).select("slot", "created_at")


@query("mem", f"SELECT slot, importance FROM mem WHERE {LIVE} ORDER BY importance DESC, slot LIMIT 50")
def list_importance(mem):
    return R.listing(mem, "importance", limit=50).select("slot", "importance")


@query("mem", f"SELECT slot FROM mem WHERE {LIVE} AND memory_type = 'semantic' ORDER BY slot")
def list_id(mem):
    return R.listing(mem, "id", types=["semantic"]).select("slot")


@query("mem", f"SELECT slot, agent_id FROM mem WHERE {LIVE} AND agent_id = 'agent-2'")
def list_agent(mem):
    return R.listing(mem, agent="agent-2").select("slot", "agent_id")


@query("mem", f"SELECT slot, importance FROM mem WHERE {LIVE} ORDER BY importance DESC, slot LIMIT 25 OFFSET 40")
def list_page(mem):
    return R.listing(mem, "importance", offset=40, limit=25).select("slot", "importance")


@query("mem", f"SELECT slot, '{{\"slot\":' || slot || ',\"agent_id\":\"' || agent_id || '\",\"scope\":\"' || scope || '\"}}' AS line FROM mem WHERE {LIVE}")
def list_json(mem):
    return R.scan_live(mem).select("slot", F.to_json(F.struct("slot", "agent_id", "scope")).alias("line"))


@query("mem", "SELECT slot, CASE WHEN length(content) > 80 THEN substring(content, 1, 79) || '…' ELSE content END AS short FROM mem")
def truncate(mem):
    return mem.select("slot", X.shortened(F.col("content"), 80).alias("short"))


@query("mem", "SELECT slot, least(greatest(importance * 3 - 1, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS clamped FROM mem")
def clamp(mem):
    return mem.select("slot", S.clamp01(F.col("importance") * 3 - 1).alias("clamped"))


_ABOUT = "lower(json_extract_string(metadata, '$.area')) = 'onboarding'"
_MANIFEST = "coalesce(lower(json_extract_string(metadata, '$.topic')) = 'manifest', false)"


@query("mem mem_meta", f"SELECT slot, importance, {_MANIFEST} AS is_manifest FROM mem JOIN mem_meta USING (slot) WHERE {LIVE} AND {_ABOUT}")
def about(mem, meta):
    return R.about(mem.join(meta, "slot")).select("slot", "importance", "is_manifest")


@query("mem mem_meta", f"SELECT slot, importance FROM mem JOIN mem_meta USING (slot) WHERE {LIVE} AND {_ABOUT} AND {_MANIFEST}")
def about_manifest_only(mem, meta):
    return R.about(mem.join(meta, "slot"), manifest_only=True).select("slot", "importance")


_Q = "(SELECT vector AS qv FROM mem WHERE slot = 0) q"


@query("mem", f"SELECT slot, {_DOT.format('vector', 'qv')} AS dot FROM mem CROSS JOIN {_Q}")
def sim_dot(mem):
    return mem.select("slot", V.dot(F.col("vector"), V.literal(first_vector(mem))).alias("dot"))


@query("mem", f"SELECT slot, {_cos('vector', 'qv')} AS cosine FROM mem CROSS JOIN {_Q}")
def sim_cosine(mem):
    return mem.select("slot", V.cosine(F.col("vector"), V.literal(first_vector(mem))).alias("cosine"))


@query("mem", f"SELECT slot, round(list_distance(vector::DOUBLE[], qv::DOUBLE[]), 6) AS distance, round(1 / (1 + list_distance(vector::DOUBLE[], qv::DOUBLE[])), 6) AS similarity FROM mem CROSS JOIN {_Q}")
def sim_l2(mem):
    d = V.l2(F.col("vector"), V.literal(first_vector(mem)))
    return mem.select("slot", F.round(d, 6).alias("distance"), F.round(1 / (1 + d), 6).alias("similarity"))


_RECENCY = f"exp(-ln(CAST(2 AS DOUBLE)) * CAST(greatest({NOW} - accessed_at, 0) AS DOUBLE) / CAST(604800 AS DOUBLE))"
_FREQUENCY = "ln(CAST(access_count AS DOUBLE) + 1)"


@query("mem", f"SELECT slot, round({_RECENCY}, 6) AS recency FROM mem")
def recency(mem):
    return mem.select("slot", F.round(S.recency(F.col("accessed_at"), NOW), 6).alias("recency"))


@query("mem", f"SELECT slot, round({_FREQUENCY}, 6) AS frequency FROM mem")
def frequency(mem):
    return mem.select("slot", F.round(S.frequency(F.col("access_count")), 6).alias("frequency"))


def _searched(metric: str, sim: str) -> None:
    body = f"SELECT slot, round(sim, 6) AS similarity FROM (SELECT slot, {sim} AS sim FROM mem CROSS JOIN {_Q} WHERE {LIVE} AND {UNEXPIRED}) ORDER BY sim DESC, slot LIMIT 10"

    def run(mem):
        return R.search(mem, first_vector(mem), 10, NOW, metric).select("slot", F.round("similarity", 6).alias("similarity"))

    run.__name__ = f"search_{metric}"
    query("mem", body)(run)


_searched("cosine", _cos("vector", "qv"))
_searched("l2", "1 / (1 + list_distance(vector::DOUBLE[], qv::DOUBLE[]))")
_searched("dot", _DOT.format("vector", "qv"))


def _recalled(name: str, where: str = "true", weights: S.Weights = S.Weights(), **request) -> None:
    w = [f"CAST({x} AS DOUBLE)" for x in (weights.similarity, weights.recency, weights.importance, weights.frequency)]
    rec = _RECENCY.replace("604800", str(weights.half_life))
    body = (
        f"SELECT slot, round(score, 6) AS score, round(sim, 6) AS similarity FROM (SELECT slot, sim, {w[0]} * sim + {w[1]} * {rec} + {w[2]} * importance + {w[3]} * {_FREQUENCY} AS score "
        f"FROM (SELECT *, {_cos('vector', 'qv')} AS sim FROM mem CROSS JOIN {_Q} WHERE {LIVE} AND {UNEXPIRED} AND {where})) ORDER BY score DESC, slot LIMIT 10"
    )

    def run(mem):
        req = R.Request(query=first_vector(mem), weights=weights, **request)
        return R.recall(mem, req, NOW).select("slot", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))

    run.__name__ = name
    query("mem", body)(run)


_recalled("recall_default")
_recalled("recall_agent", "(agent_id = 'agent-1' OR scope = 'shared')", agent_id="agent-1")
_recalled("recall_types", "memory_type IN ('semantic', 'episodic')", memory_types=["semantic", "episodic"])
_recalled("recall_weights", weights=S.Weights(0.5, 1.0, 0.7, 0.05, 86400.0))


_BATCH = (
    f"SELECT qid, slot, rank, round(score, 6) AS score FROM (SELECT qid, slot, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, slot) AS rank FROM "
    f"(SELECT q.slot AS qid, m.slot, {_cos('m.vector', 'q.vector')} + CAST(0.3 AS DOUBLE) * {_RECENCY.replace('accessed_at', 'm.accessed_at')} + CAST(0.2 AS DOUBLE) * m.importance + CAST(0.1 AS DOUBLE) * {_FREQUENCY.replace('access_count', 'm.access_count')} AS score "
    f"FROM mem m CROSS JOIN (SELECT slot, vector FROM mem WHERE slot < 20) q WHERE NOT m.deleted AND (m.ttl_secs IS NULL OR {NOW} - m.created_at < m.ttl_secs))) WHERE rank <= 10"
)


@query("mem", _BATCH)
def recall_batch(mem):
    queries = mem.where("slot < 20").select(F.col("slot").alias("qid"), F.col("vector").alias("qvector"))
    return R.recall_batch(mem, queries, R.Request(), NOW).select("qid", "slot", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("mem", _BATCH.replace("slot < 20", "slot % 20 = 0"))
def recall_batch_all(mem):
    """Every id divisible by 20 against all rows, at any size."""
    queries = mem.where("slot % 20 = 0").select(F.col("slot").alias("qid"), F.col("vector").alias("qvector"))
    return R.recall_batch(mem, queries, R.Request(), NOW).select("qid", "slot", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("mem access_log", "SELECT m.slot, coalesce(l.last_at, m.accessed_at) AS accessed_at, CAST(m.access_count + coalesce(l.n, 0) AS BIGINT) AS access_count FROM mem m LEFT JOIN (SELECT slot, max(access_log.at) AS last_at, count(*) AS n FROM access_log GROUP BY slot) l USING (slot)")
def track_access(mem, log):
    return R.touch(mem.select("slot", "accessed_at", F.col("access_count").cast("long").alias("access_count")), log).select("slot", "accessed_at", "access_count")


@query(
    "mem mem_updates",
    f"SELECT coalesce(m.slot, u.slot) AS slot, coalesce(u.content, m.content) AS content, coalesce(u.importance, m.importance) AS importance, coalesce(m.accessed_at, {NOW}) AS accessed_at, CAST(coalesce(m.access_count, 0) AS BIGINT) AS access_count, "
    "CASE WHEN u.slot IS NOT NULL THEN false ELSE m.deleted END AS deleted FROM mem m FULL JOIN (SELECT * FROM mem_updates u WHERE seq = (SELECT max(seq) FROM mem_updates v WHERE v.slot = u.slot)) u ON m.slot = u.slot",
)
def upsert(mem, updates):
    return catalog.upsert(mem, updates, NOW).select("slot", "content", "importance", "accessed_at", F.col("access_count").cast("long").alias("access_count"), "deleted")


@query("mem", "SELECT slot, deleted OR slot % 6 = 0 AS deleted FROM mem")
def soft_delete(mem):
    return catalog.delete(mem, mem.where("slot % 6 = 0").select("slot")).select("slot", "deleted")


@query("mem", f"SELECT slot, CAST(row_number() OVER (ORDER BY slot) - 1 AS BIGINT) AS new_slot FROM mem WHERE {LIVE} AND {UNEXPIRED}")
def compact(mem):
    return catalog.compact(mem, NOW).select("slot", "new_slot")


@query("mem", f"SELECT CAST(count(*) AS BIGINT) AS verified FROM mem WHERE {LIVE} AND len(vector) = 64")
def verify(mem):
    return catalog.verify(mem, 64)


@query("turns", "SELECT session_id, turn, role, content FROM turns WHERE session_id = 3")
def session_turns(turns):
    return catalog.session_turns(turns, 3).select("session_id", "turn", "role", "content")


@query("turns", "SELECT session_id, turn, CASE WHEN session_id = 3 THEN 'episodic' ELSE memory_type END AS memory_type FROM turns")
def session_consolidate(turns):
    return catalog.consolidate(turns, 3).select("session_id", "turn", "memory_type")


@query("turns", "SELECT session_id, turn, role FROM turns WHERE session_id <> 3")
def session_discard(turns):
    return catalog.discard(turns, 3).select("session_id", "turn", "role")


@query("snapshots", "SELECT txn_id, created_at, memory_count FROM snapshots")
def snapshot_list(snaps):
    return snapshots.ordered(snaps)


@query("snapshots", "SELECT txn_id, created_at, memory_count FROM snapshots WHERE txn_id = 5")
def snapshot_as_of_txn(snaps):
    return snapshots.as_of_txn(snaps, 5)


@query("snapshots", "SELECT txn_id, memory_count FROM snapshots WHERE created_at <= 1704067200 + 900000 ORDER BY txn_id DESC LIMIT 1")
def snapshot_as_of_time(snaps):
    return snapshots.as_of_time(snaps, 1704067200 + 900000).select("txn_id", "memory_count")


@query("snapshots", "SELECT txn_id, created_at FROM snapshots ORDER BY txn_id DESC LIMIT 7")
def snapshot_retention(snaps):
    return snapshots.retained(snaps, 7).select("txn_id", "created_at")


@query("cache_rows", "SELECT pos, sha256(cache_key) AS key_hash FROM cache_rows")
def cache_key_hash(rows):
    return rows.select("pos", X.key_hash(F.col("cache_key")).alias("key_hash"))


@query("cache_rows", "SELECT pos, CASE WHEN length(value) > 120 THEN substring(value, 1, 119) || '…' ELSE value END AS preview FROM cache_rows")
def cache_key_preview(rows):
    return rows.select("pos", X.key_preview(F.col("value")).alias("preview"))


_LATEST = "(SELECT * FROM cache_rows QUALIFY row_number() OVER (PARTITION BY namespace, cache_key ORDER BY pos DESC) = 1)"
_FRESH = f"(ttl_secs IS NULL OR {NOW} - created_at < ttl_secs)"


@query("cache_rows", f"SELECT pos, namespace FROM {_LATEST} WHERE {_FRESH}")
def cache_live(rows):
    return cache.latest(rows).where(cache.fresh(NOW)).select("pos", "namespace")


@query("cache_rows", f"SELECT namespace, cache_key, pos, size_bytes FROM {_LATEST}")
def cache_put_latest(rows):
    return cache.latest(rows).select("namespace", "cache_key", "pos", "size_bytes")


@query("cache_rows", f"SELECT pos, value FROM {_LATEST} WHERE namespace = 'en' AND cache_key = 'doc:7' AND {_FRESH}")
def cache_get(rows):
    return cache.get(rows, "en", "doc:7", NOW).select("pos", "value")


@query("cache_rows", f"SELECT namespace, cache_key, pos FROM {_LATEST} WHERE NOT (namespace = 'en' AND cache_key = 'doc:7')")
def cache_delete(rows):
    return cache.delete(cache.latest(rows), "en", "doc:7").select("namespace", "cache_key", "pos")


@query("cache_rows", f"SELECT count(*) AS purged FROM {_LATEST} WHERE namespace = 'en' AND NOT {_FRESH}")
def cache_purge(rows):
    return cache.purged(cache.latest(rows), NOW, "en", expired_only=True).agg(F.count("*").alias("purged"))


@query("cache_rows", f"SELECT namespace, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {_LATEST} GROUP BY namespace")
def cache_stats(rows):
    return cache.stats(cache.latest(rows))


@query(
    "cache_rows",
    f"SELECT namespace, pos FROM (SELECT *, row_number() OVER w AS n, sum(size_bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM {_LATEST} WINDOW w AS (PARTITION BY namespace ORDER BY accessed_at DESC, pos DESC)) WHERE n <= 60 AND b <= 100000",
)
def cache_lru(rows):
    return cache.within_budget(cache.latest(rows), 60, 100_000).select("namespace", "pos")


def _semantic(name: str, scale: str, model: str, threshold: float) -> None:
    body = (
        f"SELECT pos, round(sim, 6) AS similarity FROM (SELECT pos, {_cos('vector', 'qv')} AS sim FROM cache_vec CROSS JOIN (SELECT vector AS qv FROM cache_vec WHERE pos = 6) q "
        f"WHERE namespace = (SELECT namespace FROM cache_vec WHERE pos = 6) AND model = '{model}' ORDER BY sim DESC, pos LIMIT 1) WHERE sim >= CAST({threshold} AS DOUBLE)"
    )

    def run(rows):
        row = rows.where("pos = 6").first()
        return cache.semantic(rows, row["namespace"], row["vector"], model, threshold=threshold).select("pos", F.round("similarity", 6).alias("similarity"))

    run.__name__ = name
    query("cache_vec", body)(run)


_semantic("cache_semantic_hit", "1", "m-0", 0.97)
_semantic("cache_semantic_miss", "1", "m-1", 0.97)


@query("mem", "SELECT count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS deleted, (SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT DISTINCT agent_id AS a FROM mem WHERE NOT deleted)) AS agents FROM mem")
def stats(mem):
    return catalog.stats(mem)


@query("mem", "SELECT DISTINCT agent_id FROM mem WHERE NOT deleted")
def distinct_agents(mem):
    return R.scan_live(mem).select("agent_id").distinct()


@query("mem", "SELECT agent_id, memory_type, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM mem WHERE NOT deleted GROUP BY ROLLUP (agent_id, memory_type)")
def rollup_agents(mem):
    return catalog.rollup(mem)


_D2 = "list_sum(list_transform(list_zip(m.vector::DOUBLE[], c.vector::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ASSIGN = f"(SELECT slot, part FROM (SELECT m.slot, c.slot AS part, row_number() OVER (PARTITION BY m.slot ORDER BY {_D2}, c.slot) AS r FROM mem m CROSS JOIN (SELECT slot, vector FROM mem WHERE slot < 8) c) WHERE r = 1)"


def _centroids(mem):
    return mem.where("slot < 8").select(F.col("slot").alias("part"), "vector")


@query("mem", f"SELECT slot, part FROM {_ASSIGN}")
def ivf_assign(mem):
    return ann.assign(mem, _centroids(mem))


@query("mem", f"SELECT m.slot AS part FROM mem m CROSS JOIN (SELECT vector FROM mem WHERE slot = 11) c WHERE m.slot < 8 ORDER BY {_D2}, m.slot LIMIT 3")
def ivf_probe(mem):
    rows = _centroids(mem).orderBy("part").collect()  # eight rows
    index = ann.Index(np.array([r["vector"] for r in rows], np.float64), [])
    parts = ann.probe(index, first_vector(mem, 11), 3)
    return mem.where(F.col("slot").isin(parts)).select(F.col("slot").alias("part"))


@query("mem", f"SELECT part, dim, round(avg(x), 6) AS mean FROM (SELECT a.part, CAST(i - 1 AS INT) AS dim, m.vector[i]::DOUBLE AS x FROM mem m JOIN {_ASSIGN} a USING (slot) CROSS JOIN range(1, 65) t(i)) GROUP BY part, dim")
def centroid_mean(mem):
    return ann.centroid_mean(mem, ann.assign(mem, _centroids(mem))).select("part", "dim", F.round("mean", 6).alias("mean"))


@query("mem", "SELECT slot, CAST(s AS INT) AS sub, round(list_sum(vector[s * 8 + 1 : s * 8 + 8]::DOUBLE[]), 6) AS total FROM mem CROSS JOIN range(0, 8) t(s)")
def pq_split(mem):
    total = lambda s: F.aggregate(V.part(F.col("vector"), s, 8, 64), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return mem.select("slot", F.posexplode(F.array(*[F.round(total(s), 6) for s in range(8)])).alias("sub", "total"))


@query("mem")
def recall_ann(mem):
    index = ann.train(mem, n_probe=16, n_rerank=200)
    q = first_vector(mem)
    found = ann.candidates(ann.encode(mem, index), index, q)
    return R.recall(mem, R.Request(query=q), NOW, found).select("slot", F.round("score", 6).alias("score"))


@query("mem")
def ann_recall_at_10(mem):
    """Share of the exact ten nearest that the index finds, over twenty queries."""
    index = ann.train(mem, n_probe=16, n_rerank=200)
    postings, hits = ann.encode(mem, index), 0
    for s in range(1, 21):
        q = first_vector(mem, s)
        req = R.Request(query=q, weights=S.Weights(1, 0, 0, 0))
        exact = {r["slot"] for r in R.recall(mem, req, NOW).select("slot").collect()}
        hits += len(exact & {r["slot"] for r in R.recall(mem, req, NOW, ann.candidates(postings, index, q)).select("slot").collect()})
    return mem.sparkSession.createDataFrame([(hits / 200,)], "recall double")


@query("mem")
def index_info(mem):
    index = ann.train(mem)
    return ann.info(ann.encode(mem, index), index)


@query("mem", f"SELECT content, memory_type, agent_id, importance, size FROM (SELECT content, memory_type, agent_id, importance, CAST(len(vector) AS INT) AS size FROM mem WHERE {LIVE})")
def jsonl_import(mem):
    """Live rows as JSON lines, and the lines read back by the importer."""
    path = scratch(mem.sparkSession, "jsonl")
    R.scan_live(mem).select(F.to_json(F.struct("content", "vector", "memory_type", "agent_id", "importance")).alias("value")).write.text(path)
    return jsonl.read_memories(mem.sparkSession, path).select("content", "memory_type", "agent_id", "importance", F.size("vector").alias("size"))


@query("snapshots", "SELECT 'episodic' AS memory_type, '[v1] growth: ' || CAST(memory_count AS VARCHAR) || '.0 rows day ' || txn_id AS content FROM snapshots")
def perf_ingest(snaps):
    """A JSON list of measurements (one a snapshot) as episodic memories."""
    spark = snaps.sparkSession
    path = scratch(spark, "perf")
    each = F.struct(F.lit("v1").alias("version"), F.lit("growth").alias("metric"), F.col("memory_count").alias("value"), F.lit("rows").alias("units"), F.concat(F.lit("day "), F.col("txn_id").cast("string")).alias("notes"))
    snaps.groupBy("txn_id").agg(F.to_json(F.collect_list(each)).alias("value")).select("value").write.text(path, lineSep="\n")
    lines = spark.read.text(path).repartition("value")
    lists = scratch(spark, "perf-lists")
    lines.write.option("maxRecordsPerFile", 1).text(lists)
    return jsonl.perf_rows(spark, lists).select("memory_type", "content")


@query("mem")
def aead_roundtrip(mem):
    key = bytes(range(32))
    sealed = mem.select("slot", "content", crypto.seal(F.col("content"), key, F.col("slot").cast("string")).alias("sealed"))
    opened = crypto.open_sealed(F.col("sealed"), key, F.col("slot").cast("string"))
    return sealed.select("slot", (opened == F.col("content")).alias("same"), crypto.open_sealed(F.col("sealed"), key, F.lit("other")).isNull().alias("bound"))
