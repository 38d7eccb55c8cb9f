"""Documents to packed sequences: language ID, near-duplicates, decontamination, secrets, packing.

Every stage takes all rows its predecessor kept and returns the columns of `documents`; the last returns packed
pieces. Each stage is written as Parquet in the shared folder and read again by the next.

* language: rows whose language model rejects them (no text, no letters, or unlike every learned language) go. The
  models are learned from the stage's own labelled input.
* near duplicates: of each SimHash component the row with the smallest doc_id stays (of different texts under that id
  the one with the smallest hash), and of rows that repeat it one.
* contamination: documents with at least one word in twenty inside benchmark passages go; rows are told apart by id and
  text, so other texts under the same id, or without id, stay.
* secrets: every span found is replaced by a mask; n_chars follows the new text. No document is dropped here.
* packing: see `mailgrain.llm.packing`.

Rows with a null doc_id: the language stage keeps them, near-duplicates keep one row without id per component that
has no id at all. Columns beyond those of `documents` ride along through all stages but the last.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.llm import decontamination, language, packing, secrets, simhash
from mailgrain.llm.common import table, written
from mailgrain.session import ship_package


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language.identified(docs, language.train(docs))
    return judged.where("NOT __rejected").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.secrets(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    hit = F.col("__spans").isNotNull()
    text = F.when(hit, secrets.masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    joined = docs.join(found, same, "left").withColumn("text", text)
    return joined.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("contamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # language models and tokenizers are beyond SQL; tests/llm/test_pipeline.py checks every stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
