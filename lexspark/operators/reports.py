"""Reports as DataFrames: look-ups, searches, frequencies with running shares, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Dictionary
from .closure import PLACE, before, checkpointed, part_of


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def running_share(counts: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """rank, key, n, running (sum of n so far), share (of all) by n descending, then key.

    With ``limit`` one window ranks as many keys. Without it keys are sorted into ranges and written; ranks and
    sums are taken in each range, plus those of the ranges before, so no task sees all keys.
    """
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.select(key, "n").orderBy(F.desc("n"), key)
    if limit:
        w = Window.orderBy(F.desc("n"), key)
        ranked = top.limit(limit).withColumn("rank", F.row_number().over(w)).withColumn("running", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        order = checkpointed(top.withColumn("_at", F.monotonically_increasing_id()))
        rows, sums = before(order), before(order, weight="n").withColumnRenamed("_before", "_sum")
        w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        parts = order.withColumn("_part", part_of("_at")).join(F.broadcast(rows), "_part").join(F.broadcast(sums), "_part")
        rank = F.col("_before") + F.col("_at").bitwiseAND(PLACE) + 1
        ranked = parts.select(rank.cast("int").alias("rank"), key, "n", (F.col("_sum") + F.sum("n").over(w)).alias("running"))
    return ranked.crossJoin(F.broadcast(total)).select("rank", key, "n", "running", (100.0 * F.col("running") / F.col("total")).alias("share"))


def template_frequency(meanings: DataFrame) -> DataFrame:
    """Templates in meanings (text) with running shares."""
    names = meanings.select(F.explode(opened_names(F.col("text"))).alias("name"))
    return running_share(counted(names, "name"), "name")


def opened_names(text):
    """Names after every {{: also after the second of two in a row, where the name is empty."""
    pieces = F.slice(F.split(text, r"\{\{"), 2, 1 << 30)
    white = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
    return F.transform(pieces, lambda p: F.regexp_replace(F.regexp_extract(p, r"(?s)^([^|}]*)", 1), white, ""))


def skipped_headings(oddities: DataFrame, limit: int = 40) -> DataFrame:
    """Headings that are no word type but have meanings, the most frequent first."""
    return counted(oddities.where("kind = 'heading'"), "heading").orderBy(F.desc("n"), "heading").limit(limit)


def top_per_kind(events: DataFrame, kind: str = "kind", key: str = "key", sample: str = "title", limit: int = 40) -> DataFrame:
    """kind, key, n, sample (the smallest), rank up to ``limit`` in each kind."""
    counts = events.groupBy(kind, key).agg(F.count("*").alias("n"), F.min(sample).alias("sample"))
    w = Window.partitionBy(kind).orderBy(F.desc("n"), key)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def missing_words(missing: DataFrame, limit: int = 40) -> DataFrame:
    return missing.orderBy(F.desc("n"), "word").limit(limit)


def coverage(order: DataFrame, rendered: DataFrame) -> DataFrame:
    """One row: defined, entries, meanings, percent."""
    sizes = rendered.select("title", F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["meanings"])).alias("m"))
    total = rendered.agg(F.count("*").alias("entries"))
    found = order.where("kind = 'entry'").join(sizes, F.col("word") == F.col("title")).agg(F.count("*").alias("defined"), F.coalesce(F.sum("m"), F.lit(0)).alias("meanings"))
    return found.crossJoin(total).select("defined", "entries", "meanings", (100.0 * F.col("defined") / F.col("entries")).alias("percent"))


def show(dictionary: Dictionary, words: DataFrame) -> DataFrame:
    """word, status (entry, redirect, none), target, blocks of requested words (word); an entry wins over a redirect."""
    out = words.join(dictionary.entries.select(F.col("title").alias("word"), "blocks"), "word", "left").join(dictionary.redirects.select(F.col("title").alias("word"), "target"), "word", "left")
    status = F.when(F.col("blocks").isNotNull(), "entry").when(F.col("target").isNotNull(), "redirect").otherwise("none")
    return out.select("word", status.alias("status"), F.when(status == "redirect", F.col("target")).alias("target"), "blocks")


def prefix_search(pages: DataFrame, prefix: str, title: str = "title") -> DataFrame:
    return pages.where(F.startswith(title, F.lit(prefix))).select(title).orderBy(title)


def substring_search(pages: DataFrame, needle: str, limit: int = 30) -> DataFrame:
    """title, matches (how many there are) of the first templates whose text has ``needle``."""
    found = pages.where(F.startswith("title", F.lit("Template:")) & F.contains("text", F.lit(needle)))
    return found.select("title").orderBy("title").limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("matches"))))


def redirect_walk(pages: DataFrame, titles: DataFrame, hops: int = 5) -> DataFrame:
    """start, hop, title, redirect, text: the chain of each title (title), up to ``hops`` redirects; a loop just ends."""
    step = titles.select(F.col("title").alias("start"), F.lit(0).alias("hop"), "title")
    known = pages.select("title", "redirect", "text")
    out: DataFrame | None = None
    for hop in range(hops):
        found = step.join(known, "title", "left").select("start", "hop", "title", "redirect", "text")
        out = found if out is None else out.union(found)
        step = found.where("redirect IS NOT NULL").select("start", F.lit(hop + 1).alias("hop"), F.col("redirect").alias("title"))
    return out
