"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes all that the one before has kept and returns the five columns of documents; the last returns the pieces of training sequences.

* language: documents that the classifier rejects (`und`: no text, or no letter in it) go; `lang` of the others becomes the predicted language. Where no
  document is labelled there is no classifier; then documents with a letter stay, with the `lang` that they have.
* near_duplicates: of each group of documents linked at 0.8 over five-word shingles the smallest doc_id stays. Of rows that
  repeat a doc_id with the same text one stays; with different texts they all do. Rows with a null doc_id stay.
* decontamination: documents with one word in twenty or more inside benchmark windows go.
* secrets: every finding is replaced by a mark and n_chars is set anew; the documents stay.
* packing: sequences of at most 2048 tokens, with the ids of every piece.

Defined cases, of every stage: texts are read whole, whatever their length; null and empty texts are rejected by the first stage, and have no duplicates, no hits, no secrets and a piece of one end
token in the others; rows that repeat a doc_id or have none are told apart but for the second stage's rule; an empty table gives an empty result; other columns are dropped, whatever their names.
Ties: see the operators. doc_id must be integral.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontamination, language_id, minhash, packing, secrets
from folioforge.llm.common import group_join, materialise, small_batches
from folioforge.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[secret]"


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with small batches, as its workers and its JVM hold what the stages before have left, too."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = language_id.predictions(docs, COLUMNS, model=model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType)).select(COLUMNS)


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    rest = group_join(docs, gone, "doc_id", "left_anti")
    again = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rest
    same = group_join(rest, again, "doc_id", "left_semi").withColumn("same__", F.sha2("text", 256)).dropDuplicates(["doc_id", "same__"])
    return group_join(rest, again, "doc_id", "left_anti").unionByName(same.select(COLUMNS))


@lean
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where("NOT contaminated").select(COLUMNS)


@lean
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.findings(docs, COLUMNS, redact=MARK)
    length = F.when(F.size("findings") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length).select(COLUMNS)


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, cache=300_000)  # the workers hold what the stages before have left, too


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Packing and the classifier are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
