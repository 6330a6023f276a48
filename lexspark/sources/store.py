"""The dictionary as Parquet tables: entries, redirects, pages, oddities, and _meta written last."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dump
from ..operators.sections import english_sections

MEANINGS = "array<struct<depth: smallint, text: string>>"
BLOCKS = f"array<struct<word_type: string, meanings: {MEANINGS}>>"


@dataclass(frozen=True)
class Dictionary:
    """title and blocks of entries, title and target of redirects, title, redirect and text of pages."""

    entries: DataFrame
    redirects: DataFrame
    pages: DataFrame
    oddities: DataFrame
    meta: dict

    def meanings(self) -> DataFrame:
        """One row per meaning: title, block_idx, word_type, meaning_idx, depth, text."""
        return flat(self.entries)


def flat(entries: DataFrame) -> DataFrame:
    blocks = entries.select("title", F.posexplode("blocks").alias("block_idx", "block"))
    lines = blocks.select("title", "block_idx", "block.word_type", F.posexplode("block.meanings").alias("meaning_idx", "m"))
    return lines.select("title", "block_idx", "word_type", "meaning_idx", "m.depth", "m.text")


def last_wins(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("title").agg(*[F.max_by(c, "page_seq").alias(c) for c in columns])


class Hadoop:
    """Files of any store that the session reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, files = self._at(path)
        return files.exists(p)

    def delete(self, path: str) -> None:
        p, files = self._at(path)
        files.delete(p, True)

    def move(self, path: str, to: str) -> None:
        """Put a folder in another's place; what was there stays aside until the new one is in, and comes back if it can't be."""
        p, files = self._at(path)
        target, aside = self.jvm.org.apache.hadoop.fs.Path(to), self.jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}.before")
        if files.exists(target):
            files.delete(aside, True)
            files.rename(target, aside)
        if files.rename(p, target):
            files.delete(aside, True)
        else:
            if files.exists(aside):
                files.rename(aside, target)
            raise OSError(f"{path} can't be moved to {to}")


def write(spark: SparkSession, path: str, sha1: str, entries: DataFrame, redirects: DataFrame, pages: DataFrame, oddities: DataFrame | None = None, counts: dict | None = None) -> dict:
    """Write the tables beside ``path``, then _meta, then move all to ``path`` at once.

    Readers never see a part. A title that two entries have is an error.
    """
    files, stage = Hadoop(spark), f"{path.rstrip('/')}._{uuid.uuid4().hex}"
    try:
        entries.write.parquet(f"{stage}/entries")
        redirects.write.parquet(f"{stage}/redirects")
        pages.write.parquet(f"{stage}/pages")
        (oddities if oddities is not None else spark.createDataFrame([], "title string, kind string, heading string, n long")).write.parquet(f"{stage}/oddities")
        done = {t: spark.read.parquet(f"{stage}/{t}") for t in ("entries", "redirects", "pages")}
        twice = done["entries"].groupBy("title").count().where("count > 1").orderBy("title").first()
        if twice:
            raise ValueError(f"two entries are called {twice['title']}")
        n_meanings = F.coalesce(F.sum(F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["meanings"]))), F.lit(0))
        words, meanings = done["entries"].agg(F.count("*"), n_meanings).first()
        meta = {"sha1": sha1, "entries": words, "meanings": meanings, "redirects": done["redirects"].count(), "pages": done["pages"].count()} | (counts or {})
        spark.createDataFrame([meta], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in meta.items())).coalesce(1).write.parquet(f"{stage}/_meta")
        files.move(stage, path)
    except BaseException:
        files.delete(stage)
        raise
    return meta


def read(spark: SparkSession, path: str, sha1: str | None = None) -> Dictionary:
    """Read a dictionary; refuses one without _meta, with other counts, or of another dump than ``sha1``."""
    path = path.rstrip("/")
    if not Hadoop(spark).exists(f"{path}/_meta"):
        raise FileNotFoundError(f"{path} holds no finished dictionary")
    meta = spark.read.parquet(f"{path}/_meta").first().asDict()
    if sha1 is not None and meta["sha1"] != sha1:
        raise ValueError(f"{path} was made from another dump ({meta['sha1']})")
    out = Dictionary(*(spark.read.parquet(f"{path}/{t}") for t in ("entries", "redirects", "pages", "oddities")), meta)
    if out.entries.count() != meta["entries"]:
        raise ValueError(f"{path} is damaged: {meta['entries']} entries are missing or too many")
    return out


def extract(spark: SparkSession, dump_path: str, path: str, sha1: str | None = None) -> dict:
    """Dump to dictionary: scan, route, parse sections, write. With ``sha1``, a file of another digest is refused.

    The dump is decoded once: kept pages go to a table by kind, from which the rest is made.
    """
    found = dump.digest(dump_path)
    if sha1 is not None and found.sha1 != sha1:
        raise ValueError(f"{dump_path} has SHA-1 {found.sha1}")
    files, stage = Hadoop(spark), f"{path.rstrip('/')}._kept_{uuid.uuid4().hex}"
    try:
        scanned = dump.pages(spark, dump_path)
        counted = scanned.withColumn("kept", F.col("ns").isin(*dump.KEPT))
        slim = counted.withColumn("escaped", F.when(F.coalesce("kept", F.lit(False)), F.col("escaped")))
        all_kinds = dump.routed(slim).withColumn("kind", F.when(F.coalesce("kept", F.lit(False)), F.col("kind")).otherwise("other"))
        checked = all_kinds.withColumn("title", F.when((F.col("kind") != "other") & F.col("title").isNull(), F.raise_error(F.lit("a page without a title")).cast("string")).otherwise(F.col("title")))
        checked.drop("kept").write.partitionBy("kind").parquet(stage)
        rows = spark.read.option("basePath", stage).parquet(stage)
        totals = rows.agg(F.count("*").alias("all_pages"), F.count_if(F.col("ns") == dump.ENTRY).alias("main_pages")).first().asDict()
        of = lambda kind: rows.where(F.col("kind") == kind)
        sections = english_sections(dump.decoded(of("entry"), "title", "escaped"))
        entries = sections.where(F.size("blocks") > 0).select("page_seq", "title", "blocks")
        redirects = last_wins(dump.decoded(of("redirect"), "title", "redirect").withColumnRenamed("redirect", "target"), "target")
        pages = last_wins(dump.decoded(of("page"), "title", "redirect", "escaped"), "redirect", "text")
        skipped = sections.select("title", F.explode("skipped").alias("heading")).select("title", F.lit("heading").alias("kind"), "heading", F.lit(1).cast("long").alias("n"))
        orphans = sections.where("orphans > 0").select("title", F.lit("orphan").alias("kind"), F.lit(None).cast("string").alias("heading"), F.col("orphans").cast("long").alias("n"))
        return write(spark, path, found.sha1, entries, redirects, pages, skipped.union(orphans), totals | {"compressed_bytes": found.bytes})
    finally:
        files.delete(stage)
