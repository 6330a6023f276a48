"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import importlib.util
import os
import secrets
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file: in LEXSPARK_TOKENIZERS, else in the installed package of vocabularies."""
    if folder := os.environ.get("LEXSPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def pii_key() -> str:
    """The secret of all surrogates: LEXSPARK_PII_KEY, else one drawn for this driver, which nobody can repeat."""
    return os.environ.get("LEXSPARK_PII_KEY") or secrets.token_hex(32)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates and the number of entities; fails if two entities of a type share a surrogate."""
    from .common import materialize
    from .pii import collisions, pseudonymize

    found = materialize(pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(), keep_entities=True), "surrogates")
    if shared := collisions(found).where("collisions > 0").collect():
        raise ValueError(f"surrogates stand for several entities: {shared}")
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("entities"))


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_nbest

    return encode_nbest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_tokens, token_folder, write_tokens

    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, token_folder(docs), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op7_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write archives, then read responses with their payloads, and revisits by their headers alone."""
    from .common import materialize, new_path
    from .warc import page_digests, register, revisits, write_warc

    register(spark)
    pages, folder = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    write_warc(pages, folder, materialize(revisits(pages), "revisits")).write.format("noop").mode("overwrite").save()
    whole = spark.read.format("warc").load(folder).where("record_type = 'response'")
    again = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")
    return page_digests(whole).union(page_digests(again))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store texts as images with halved chroma, load their RGB tensors as a column, and digest both."""
    from .jpeg import digest, load_images, store_texts

    return digest(load_images(store_texts(table(spark, sf_dir, "documents")), details=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_nbest_pieces": op2_nbest_pieces,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op10_progressive_jpeg": op10_progressive_jpeg,
    "op9_repetition_quality": op9_repetition_quality,
    "op4_toxicity_nnpu": op4_toxicity_nnpu,
    "op5_simhash_covering": op5_simhash_covering,
    "op6_token_store": op6_token_store,
    "op7_warc_source": op7_warc_source,
    "op8_harmonic_packing": op8_harmonic_packing,
}
ORACLES: dict[str, str] = {
    "op7_warc_source": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
        FROM g""",
}
