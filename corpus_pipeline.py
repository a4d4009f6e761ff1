"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
back as the next stage's docs.  All but the last return the columns of docs.

Nulls, empty texts and extra columns pass through the stages; what each does
with them is stated in its operator's module.  A language is missing only from
texts without letters, which the second stage therefore rejects; so nulls and
empty texts end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlint.llm import bpe, decontaminate, langid, neardup, toxicity
from vectorlint.session import materialize


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, hash of the text) is not among the rejected (doc_id, text_key)."""
    r = rejected.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(r, docs["doc_id"].eqNullSafe(r["__id"]) & (F.xxhash64(docs["text"]) == r["__key"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(docs["text"], model)["score"] < toxicity.THRESHOLD)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learned languages; if none was learned,
    rows whose text has a letter."""
    learned = langid.prototypes(langid.training_rows(docs))
    if not learned:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    return docs.where(langid.identify(docs["text"], learned)["lang_pred"] != langid.UNKNOWN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (that of the smallest id);
    of rows that repeat id and text, one."""
    found = materialize(neardup.near_duplicates(docs), "near-duplicates")
    kept = _without(docs, materialize(found.where("NOT kept").select("doc_id", "text_key").distinct(), "rejected"))
    repeated = materialize(found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    # distinct as it is: behind a shuffle Spark knows its size in memory before it may broadcast it
    r = repeated.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    once = docs.join(r, docs["doc_id"].eqNullSafe(r["__id"]) & (F.xxhash64(docs["text"]) == r["__key"]), "left_semi")
    return _without(kept, repeated).unionByName(once.dropDuplicates(["doc_id", "text"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, materialize(found.select("doc_id", "text_key").distinct(), "rejected"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.round_trip_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Stages learn and decode in ways that SQL can't express; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


PIPELINE_QUERY = {"pipeline": run}
PIPELINE_ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
