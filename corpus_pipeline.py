"""A corpus pipeline: each stage reads what the one before kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memstore.llm.common import WRITING, Scratch, free_heap, held_out
from memstore.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What SQL can't express here: learned models and tokenization.  Tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text or no letters); lang becomes the predicted one.

    Profiles are learned from the stage's own documents that have a language, without the
    quarter that is held out; where there are none, the rest keep the lang that they have."""
    from memstore.llm.langid import UNKNOWN, learn, predict

    profiles = learn(docs.where(~held_out("doc_id", 4, 2)))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = predict(docs.withColumn("__text", F.col("text")), profiles, text_col="text", keep=["__text", "source", "n_chars"])
    return judged.where(F.col("lang_pred") != UNKNOWN).select("doc_id", F.col("__text").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    from memstore.llm.jaccard import jaccard_components

    return jaccard_components(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that stand anywhere else; documents left without a letter or digit go."""
    from memstore.llm.suffix import remove_repeats

    cut = remove_repeats(docs, keep=["lang", "source"], texts=True)
    cut = cut.where(F.col("kept").rlike(r"[\p{L}\p{N}]"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    from memstore.llm.pii import redact

    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    from memstore.llm.packing import pack

    return pack(docs, vocabulary())


def fresh(stage):
    """The stage on heaps that the one before has given back.  Rows reach Python in small batches in the
    whole session from then on, as a stage's result is computed after it returns; results don't depend on them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(key, WRITING[key])
        free_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, fresh(stage)) for name, stage in [("language ID", language), ("near duplicates", near_duplicates), ("repeats", repeats), ("personal data", personal_data), ("packing", packing)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
