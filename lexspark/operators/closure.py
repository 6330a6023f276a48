"""The ordered closure of a start text: its words, the words of their definitions, and so on.

Where a line leads depends on that line alone, so edges of all entries are made once, in parallel.
A level then joins the entries found last with their edges; an entry's place in the order
is its earliest (rank of the parent, line, token, part). The first missing word brings
in the note that stands for a definition, whose own words count once, right after that line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lookup import edges, known_forms
from .tokens import word_array

NOTE = "(no entry in English Wiktionary)"
START = ""  # the start text's parent; no page is called so
AFTER = 1 << 30  # the note's tokens come after all of the line's own


@dataclass(frozen=True)
class Closure:
    """order: ord long, kind (entry or missing), word. missing: word, n long, first_ord long."""

    order: DataFrame
    missing: DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster shares (spark.checkpoint.dir)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexspark-"))
    return df.checkpoint()


def entry_lines(rendered: DataFrame) -> DataFrame:
    """parent, line, text of rendered entries (title, blocks): each word type, then its meanings."""
    texts = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(b["word_type"]), F.transform(b["meanings"], lambda m: m["text"]))))
    return rendered.select(F.col("title").alias("parent"), F.posexplode(texts).alias("line", "text"))


def close(spark: SparkSession, rendered: DataFrame, redirects: DataFrame, start: DataFrame, note: str = NOTE, keep=checkpointed) -> Closure:
    """Run the closure from ``start`` (line_no, line) over rendered entries (title, blocks) and redirects (title, target).

    ``keep`` materialises a table that is used again. The loop runs once a level of the word graph; all that comes to
    the driver are the level's counts and, once, the place of the first missing word.
    """
    known = keep(known_forms(rendered.select("title"), redirects))
    first = start.select(F.lit(START).alias("parent"), F.col("line_no").alias("line"), F.col("line").alias("text"))
    lines = entry_lines(rendered).union(first).select("parent", "line", word_array(F.col("text")).alias("words"))
    noted = spark.createDataFrame([(None, 0, note)], "parent string, line int, text string").select(F.lit(START + "\0note").alias("parent"), "line", word_array(F.col("text")).alias("words"))
    all_edges = keep(edges(keep(lines.union(noted)), known, keep))
    note_edges = all_edges.where(F.col("parent") == START + "\0note")
    frontier = spark.createDataFrame([(START, 0)], "parent string, q long")
    seen = spark.createDataFrame([], "target string")
    items: DataFrame | None = None
    told, level = False, 0
    while True:
        met = frontier.join(all_edges, "parent").select("kind", "target", F.struct("q", "line", "tok", "path").alias("key"))
        met = keep(met)
        if not told and (place := met.where("kind = 'missing'").agg(F.min(F.struct("key.q", "key.line"))).first()[0]):
            told = True
            extra = note_edges.select("kind", "target", F.struct(F.lit(place["q"]).cast("long").alias("q"), F.lit(place["line"]).alias("line"), (F.col("tok") + AFTER).alias("tok"), "path").alias("key"))
            met = keep(met.union(extra))
        entries = met.where("kind = 'entry'").groupBy("target").agg(F.min("key").alias("key")).join(seen, "target", "left_anti")
        # Ascending, not dense: the order within a level is all that the next one needs.
        ranked = keep(entries.orderBy("key").withColumn("q", F.monotonically_increasing_id()))
        missing = met.where("kind = 'missing'").groupBy("target").agg(F.min("key").alias("key"), F.count("*").alias("n"))
        rows = ranked.select(F.lit("entry").alias("kind"), "target", F.lit(level).alias("level"), "key", F.lit(1).cast("long").alias("n")).union(missing.select(F.lit("missing"), "target", F.lit(level), "key", "n"))
        items = keep(rows if items is None else items.union(rows))
        if ranked.isEmpty():
            break
        seen = keep(seen.union(ranked.select("target")))
        frontier = ranked.select(F.col("target").alias("parent"), "q")
        level += 1
    once = items.groupBy("kind", "target").agg(F.min(F.struct("level", "key")).alias("at"), F.sum("n").alias("n"))
    order = keep(once.select("kind", F.col("target").alias("word"), "n", "at").orderBy("at").withColumn("_at", F.monotonically_increasing_id()).drop("at"))
    numbered = order.join(F.broadcast(before(order)), part_of("_at") == F.col("_part")).withColumn("ord", F.col("_before") + F.col("_at").bitwiseAND(PLACE))
    return Closure(numbered.select("ord", "kind", "word"), numbered.where("kind = 'missing'").select("word", "n", F.col("ord").alias("first_ord")))


#: The lower bits of ``monotonically_increasing_id``: a row's place in its partition.
PLACE = (1 << 33) - 1


def part_of(place: str) -> Column:
    """The partition in an id made by ``monotonically_increasing_id``."""
    return F.shiftright(place, 33)


def before(ordered: DataFrame, place: str = "_at", weight: str | None = None) -> DataFrame:
    """_part, _before: how many rows (or how much of ``weight``) the partitions before hold; one row a partition."""
    sizes = ordered.groupBy(part_of(place).alias("_part")).agg((F.sum(weight) if weight else F.count("*")).alias("_size"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select("_part", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))


def reached(edge_rows: DataFrame, start: DataFrame, keep=checkpointed) -> DataFrame:
    """word: what is reachable over edges (parent, target) from start (word), itself included; no order."""
    frontier = keep(start.select("word").distinct())
    seen = frontier
    while not frontier.isEmpty():
        frontier = keep(frontier.join(edge_rows, F.col("word") == F.col("parent")).select(F.col("target").alias("word")).distinct().join(seen, "word", "left_anti"))
        seen = keep(seen.union(frontier))
    return seen
