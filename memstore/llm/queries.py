"""The thin opN_<name> queries: production parameters, whole tables, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memstore.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.langid import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    return predict(docs, learn(docs.where("not held_out")), keep=["held_out"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return score(docs, fit(docs, labels), keep=["held_out"])


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.toxicity import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return predict(docs, fit(docs, labels), keep=["held_out"])


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memstore.llm.rules import apply_rules, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_jaccard": op2_jaccard,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_suffix": op5_suffix,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_rules": op9_rules,
    "op10_quality": op10_quality,
}

_REACH = """reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)"""

#: DuckDB SQL for those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_neardup": f"""WITH RECURSIVE good AS (
 SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
 WHERE list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)) >= CAST(0.93 AS DOUBLE)),
{_REACH},
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
 e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op2_jaccard": f"""WITH RECURSIVE words AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id
 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{_REACH},
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.m, s.doc_id)) AS component_id,
 s.doc_id = least(s.doc_id, coalesce(low.m, s.doc_id)) AS kept
FROM sets s LEFT JOIN low ON low.a = s.doc_id""",
}
