"""A corpus pipeline of the training-data operators: documents become packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import materialize
from lexspark.llm.packing import pack
from lexspark.llm.pii import pseudonymize
from lexspark.llm.queries import pii_key, tokenizer_path
from lexspark.llm.simhash import keep_one
from lexspark.llm.suffix import remove_repeated_text
from lexspark.llm.toxicity import drop_toxic, train

#: Near duplicates share this much of their shingles of WIDTH words; RADIUS is that of the SimHash candidates.
WIDTH, SIMILARITY, RADIUS = 5, 0.8, 5


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier, fitted on labels and these documents, finds toxic."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return keep_one(docs, WIDTH, RADIUS, SIMILARITY)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 100 bytes or more out that are in an earlier document or place."""
    return _counted(remove_repeated_text(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data and secrets."""
    return _counted(pseudonymize(docs, pii_key()).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences; one row per piece."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("suffix_dedup", passage_dedup), ("pii", personal_data), ("packing", packing)]
#: Classifier, fingerprints and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
