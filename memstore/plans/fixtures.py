"""Relations derived from the driver's tables; each text runs on Spark SQL and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-02-01 UTC, later than every derived time.
NOW = 1706745600

RELATIONS = {
    "mem": """SELECT e.vec_id AS slot,
 CASE e.vec_id % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
 e.embedding AS vector, coalesce(d.text, concat('memory ', CAST(e.vec_id AS STRING))) AS content,
 concat('agent-', CAST(e.vec_id % 5 AS STRING)) AS agent_id,
 CASE WHEN e.vec_id % 3 = 0 THEN concat('session-', CAST(e.vec_id % 20 AS STRING)) END AS session_id,
 CASE WHEN e.vec_id % 7 = 0 THEN 'shared' ELSE 'private' END AS scope,
 CAST(1704067200 + e.vec_id * 1200 AS BIGINT) AS created_at,
 CAST(1704067200 + e.vec_id * 1200 + (e.vec_id * 7919) % 200000 AS BIGINT) AS accessed_at,
 CAST(e.vec_id % 13 AS INT) AS access_count, CAST(e.vec_id % 101 AS DOUBLE) / 100 AS importance,
 CASE WHEN e.vec_id % 11 = 0 THEN CAST(86400 * (1 + e.vec_id % 30) AS BIGINT) END AS ttl_secs,
 (e.vec_id % 17 = 16) AS deleted
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "mem_meta": """SELECT vec_id AS slot,
 CASE WHEN vec_id = 100 THEN '{"area":"onboarding","topic":"Manifest"}' WHEN vec_id % 50 = 25 THEN '{"area":"Onboarding","topic":"guide"}'
      WHEN vec_id % 25 = 0 THEN '{"area":"onboarding","topic":"guide"}' WHEN vec_id % 3 = 0 THEN '{"role":"user"}' ELSE '{}' END AS metadata
FROM embeddings""",
    "access_log": "SELECT event_id % 500 AS slot, 1704067200 + (event_id % 10000) * 250 AS at FROM events WHERE event_type IN ('view', 'click')",
    "mem_updates": """SELECT vec_id AS slot, v.seq AS seq, concat('update ', CAST(v.seq AS STRING)) AS content, CAST((vec_id + v.seq) % 101 AS DOUBLE) / 100 AS importance
FROM embeddings CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 AS seq) v WHERE vec_id % 10 = 0
UNION ALL SELECT 100000 + vec_id AS slot, 1 AS seq, 'new row' AS content, CAST(0.5 AS DOUBLE) AS importance FROM embeddings WHERE vec_id < 20""",
    "turns": """SELECT conv_id AS session_id, turn, role, text AS content, 'working' AS memory_type, concat('agent-', CAST(conv_id % 5 AS STRING)) AS agent_id
FROM conversations""",
    "snapshots": """SELECT txn_id, 1704067200 + txn_id * 86400 AS created_at, CAST(sum(n) OVER (ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS memory_count
FROM (SELECT row_number() OVER (ORDER BY d) AS txn_id, n FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)) a) b""",
    "cache_rows": """SELECT doc_id AS pos, lang AS namespace, concat('doc:', CAST(doc_id % 400 AS STRING)) AS cache_key, text AS value, n_chars AS size_bytes,
 1704067200 + doc_id AS created_at, 1704067200 + (doc_id * 7919) % 200000 AS accessed_at, CASE WHEN doc_id % 9 = 0 THEN CAST(3600 AS BIGINT) END AS ttl_secs
FROM documents""",
    "cache_vec": "SELECT vec_id AS pos, concat('ns-', CAST(label % 3 AS STRING)) AS namespace, concat('m-', CAST(vec_id % 2 AS STRING)) AS model, embedding AS vector FROM embeddings",
}
SOURCES = {"mem": ("embeddings", "documents"), "mem_meta": ("embeddings",), "access_log": ("events",), "mem_updates": ("embeddings",), "turns": ("conversations",), "snapshots": ("events",), "cache_rows": ("documents",), "cache_vec": ("embeddings",)}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the Parquet tables, without temporary views."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    text = RELATIONS[name]
    for t in SOURCES[name]:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    if name == "mem_meta":
        text = text.replace('{"', '{{"').replace('"}', '"}}').replace("'{}'", "'{{}}'")
    return spark.sql(text, **frames)


def sql(names: str, body: str) -> str:
    """A DuckDB query with the named relations as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names.split()) + " " + body
