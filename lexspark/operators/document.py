"""The document sink: head, body and all entries of a closure in order, as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .closure import NOTE

MARKER = "[definitions]"


def credit_text(dump_file: str, sha1: str, dump_date: str, project: str) -> str:
    """The attribution that the definitions' licence asks for."""
    return (
        f"The definitions below are taken from English Wiktionary (https://en.wiktionary.org/), written by Wiktionary's contributors, as published in the database dump of {dump_date} ({dump_file}, SHA-1 {sha1}). "
        f"{project} changed them: it turned Wiktionary's markup into plain text, kept only English meanings and their sub-meanings, and left out examples, quotations and notices for Wiktionary's editors. "
        "The definitions, and this licence text with them, are shared under the Creative Commons Attribution-ShareAlike 4.0 International licence (CC BY-SA 4.0): https://creativecommons.org/licenses/by-sa/4.0/"
    )


def numbered(depths):
    """The number of each meaning (array of depths): counted per depth, from the last shallower meaning on.

    A depth that was skipped counts from 0. Native: the state is the array of counters.
    """
    start = F.struct(F.array().cast("array<int>").alias("counters"), F.array().cast("array<int>").alias("out"))

    def step(state, depth):
        d = F.greatest(depth.cast("int"), F.lit(1))
        shallower = F.slice(F.concat(state["counters"], F.array_repeat(F.lit(0), d)), F.lit(1), d - 1)
        mine = F.coalesce(F.get(state["counters"], d - 1), F.lit(0)) + 1
        return F.struct(F.concat(shallower, F.array(mine)).alias("counters"), F.concat(state["out"], F.array(mine)).alias("out"))

    return F.aggregate(depths, start, step, lambda s: s["out"])


def entry_lines(rendered: DataFrame) -> DataFrame:
    """title, lines array<string> of rendered entries (title, blocks): quoted title, word types, numbered meanings, a blank line."""

    def block(b):
        numbers = numbered(F.transform(b["meanings"], lambda m: m["depth"]))
        texts = F.transform(F.arrays_zip(b["meanings"].alias("m"), numbers.alias("n")), lambda x: F.concat(F.repeat(F.lit("   "), F.greatest(x["m"]["depth"].cast("int"), F.lit(1)) - 1), x["n"].cast("string"), F.lit(". "), x["m"]["text"]))
        return F.concat(F.array(b["word_type"]), texts)

    title = F.concat(F.lit('"'), F.col("title"), F.lit('":'))
    return rendered.select("title", F.concat(F.array(title), F.flatten(F.transform("blocks", block)), F.array(F.lit(""))).alias("lines"))


def document(spark: SparkSession, text: list[str], order: DataFrame, rendered: DataFrame, credit: str, note: str = NOTE) -> DataFrame:
    """(part int, ord long, line_no int, line) in the order of the document.

    ``text`` are the start text's lines: name first; the line of the credit; the body from "Definitions" on, in
    which the marker stands for the closure's items.
    """
    own = next((x for x in text if x.startswith("Credit:")), "")
    body_at = next((i for i, x in enumerate(text) if x.strip() == "Definitions"), len(text))
    head = [text[0] if text else "", "", own, "", credit, ""]
    body = text[body_at:]
    marks = [i for i, x in enumerate(body) if x.strip() == MARKER]
    fixed = [(0, 0, i, x) for i, x in enumerate(head)] + [(1 + i, 0, 0, x) for i, x in enumerate(body) if i not in marks]
    lines = spark.createDataFrame(fixed, "part int, ord long, line_no int, line string")
    found = order.join(entry_lines(rendered).withColumnRenamed("title", "word"), "word", "left")
    missing = F.array(F.concat(F.lit('"'), F.col("word"), F.lit('":')), F.lit(note), F.lit(""))
    texts = found.select("ord", F.posexplode(F.when(F.col("kind") == "entry", F.col("lines")).otherwise(missing)).alias("line_no", "line"))
    for at in marks:
        lines = lines.union(texts.select(F.lit(1 + at).alias("part"), "ord", "line_no", "line"))
    return lines


def write_document(lines: DataFrame, path: str) -> None:
    """Write the lines in order to a folder whose part files, by name, are the document."""
    ordered = lines.repartitionByRange("part", "ord", "line_no").sortWithinPartitions("part", "ord", "line_no")
    ordered.select("line").write.mode("overwrite").text(path)
