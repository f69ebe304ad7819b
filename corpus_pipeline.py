"""A corpus pipeline of four stages; each takes (spark, docs, sf_dir) and returns the documents it keeps.

Language identification drops documents without a language; of each group of near duplicates the document with the
smallest id stays, and one of rows that repeat both id and text; personal data is replaced by its kind; what is left is packed.
Documents without an id are kept by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm import common, language_id, ngram_join, packing, pii


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; `und`, that is null texts and texts without a letter, goes.

    All other rows stay as they are, repeated ones and those without an id included.
    """
    common.bounded_batches(spark)
    network = language_id.fit(language_id.training_rows(docs.select("doc_id", "text", "lang")))
    mine = docs.toDF(*(f"_{c}" for c in docs.columns))  # so that no column has the name of a prediction
    found = language_id.languages(mine, network, "_doc_id", "_text").where("lang_pred != 'und'")
    return found.select(*mine.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more.

    Rows with equal ids and different texts are documents of their own. Texts without words are in no component and stay.
    """
    common.bounded_batches(spark)
    found = common.table(ngram_join.classified(docs), "classified")
    first = found.where("root is not null and id is not null").groupBy("root").agg(F.min(F.struct("id", "h")).alias("f")).select("f.id", "f.h")
    kept = first.union(found.where("root is null and id is not null").select("id", "h")).toDF("_id", "_h").distinct()
    hashed = docs.withColumn("_h2", F.coalesce(F.xxhash64("text"), F.lit(0)))
    stay = hashed.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_h2") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "_h2"])
    return stay.select(*docs.columns).union(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets for each span of personal data."""
    common.bounded_batches(spark)
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    common.bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the language model, the pattern bootstrapping or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written, and read as the next one's documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
