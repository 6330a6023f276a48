"""MediaWiki XML dumps, plain or compressed, as a DataFrame of pages.

The text source splits records at each closing page tag, so a bzip2 file is decoded in parallel by
Hadoop's splittable codec, which also checks every block. ``<`` is always escaped inside values,
so tags found by regular expressions are tags.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_text

#: The namespaces of entries, templates and modules.
ENTRY, TEMPLATE, MODULE = 0, 10, 828
KEPT = (ENTRY, TEMPLATE, MODULE)

_PAGE = "<page>"
_OPEN = r"(?m)^[ \t\r\x0c]*<page>[ \t\r\x0c]*$"
_TEXT = r"(?s)<text(?:[^>]*[^>/])?>(.*?)</text>"


def _fail(when: Column, what: str, otherwise: Column) -> Column:
    return F.when(when, F.raise_error(F.lit(what)).cast("string")).otherwise(otherwise)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_seq long (dump order), ns long, title, redirect, escaped (text as in the file) of all pages.

    Title and redirect are still escaped too; ``decoded`` decodes what is kept. A page in a page,
    a dump that ends in one and an unreadable namespace are errors. A text of several
    revisions is their concatenation.
    """
    raw = spark.read.option("lineSep", "</page>").text(path).where(F.contains("value", F.lit(_PAGE)))
    at = F.instr("value", _PAGE)
    rest = F.substr(F.col("value"), at + len(_PAGE))
    alone = F.rlike(F.substr(F.col("value"), F.lit(1), at + len(_PAGE) - 1), F.lit(r"(?m)^[ \t\r\x0c]*<page>\z")) & F.rlike(rest, F.lit(r"(?m)\A[ \t\r\x0c]*$"))
    opened = F.when(_several("value", _PAGE), F.regexp_count("value", F.lit(_OPEN))).otherwise(alone.cast("int"))
    checked = raw.select(opened.alias("opened"), rest.alias("value")).where("opened > 0")
    cut = F.contains("value", F.lit("</mediawiki>")) & F.rlike("value", F.lit(r"</mediawiki>\s*\z"))
    value = _fail(F.col("opened") > 1, "a page inside a page", _fail(cut, "the dump ended inside a page", F.col("value")))
    checked = checked.select(value.alias("value")).withColumn("head", F.substring_index("value", "<text", 1)).withColumn("ns", F.regexp_extract("head", r"<ns>(.*?)</ns>", 1))
    head, ns = F.col("head"), F.col("ns")
    number = F.when(ns == "", None).otherwise(_fail(~F.rlike(ns, F.lit(r"^[+-]?\d+$")), "unreadable namespace", ns)).cast("long")
    numbered = checked.select(
        F.monotonically_increasing_id().alias("page_seq"),
        F.when(F.monotonically_increasing_id() >= 0, number).alias("ns"),  # always; filters on it stay above, so what is below is worked out once
        F.when(F.rlike(head, F.lit("<title>.*?</title>")), F.regexp_extract(head, r"<title>(.*?)</title>", 1)).alias("title"),
        F.when(F.rlike(head, F.lit('<redirect title=".*?" />')), F.regexp_extract(head, r'<redirect title="(.*?)" />', 1)).alias("redirect"),
        "value",
    )
    return numbered.select("page_seq", "ns", "title", "redirect", _escaped("value").alias("escaped"))


def _several(column: str, mark: str) -> Column:
    """Whether a mark is there more than once."""
    return F.octet_length(F.substring_index(column, mark, 2)) < F.octet_length(column)


def _escaped(value: str) -> Column:
    """The texts of a page, escaped. One text, as pages have, is cut out without regular expressions."""
    inner = F.substring_index(F.substring_index(value, "</text>", 1), "<text", -1)
    end = F.instr(inner, ">")
    one = F.contains(value, F.lit("</text>")) & F.contains(F.substring_index(value, "</text>", 1), F.lit("<text")) & ~_several(value, "<text") & ~_several(value, "</text>")
    one = one & (end > 0) & (F.substr(inner, end - 1, F.lit(1)) != "/")
    unclosed = F.regexp_count(value, F.lit(r"<text(?:[^>]*[^>/])?>")) > F.regexp_count(value, F.lit("</text>"))
    return F.when(one, F.substr(inner, end + 1)).otherwise(_fail(unclosed, "a text without an end", F.array_join(F.regexp_extract_all(value, F.lit(_TEXT), F.lit(1)), "")))


def kept(pages_: DataFrame, namespaces: tuple[int, ...] = KEPT) -> DataFrame:
    """Pages of these namespaces; one without a title is an error. Filtered before anything is decoded."""
    found = pages_.where(F.col("ns").isin(*namespaces))
    return found.withColumn("title", _fail(F.col("title").isNull(), "a page without a title", F.col("title")))


def routed(kept_: DataFrame) -> DataFrame:
    """``kept`` with its kind: page (a template or module), redirect, entry, or dropped.

    An entry must name its language somewhere: a cheap test before anything is decoded or parsed.
    """
    kind = F.when(F.col("ns") != ENTRY, "page").when(F.col("redirect").isNotNull(), "redirect").when(F.contains("escaped", F.lit("English")), "entry").otherwise("dropped")
    return kept_.withColumn("kind", kind)


def decoded(rows: DataFrame, *columns: str) -> DataFrame:
    """These escaped columns decoded, ``escaped`` as ``text``."""
    for c in columns:
        rows = rows.withColumn("text" if c == "escaped" else c, xml_text(F.col(c)))
    return rows.drop("escaped") if "escaped" in columns else rows


@dataclass(frozen=True)
class Digest:
    sha1: str
    bytes: int


def digest(path: str) -> Digest:
    """SHA-1 and size of a file, read as a stream."""
    where, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    sha1, size = hashlib.sha1(), 0
    with where.open_input_stream(at, compression=None) as source:
        while block := source.read(1 << 20):
            sha1.update(block)
            size += len(block)
    return Digest(sha1.hexdigest(), size)


def start_text(spark: SparkSession, path: str, credit: str = "Credit:", marker: str = "[definitions]") -> DataFrame:
    """(line_no int, line) of a start text without its first line, credit, marker and blank lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))
    bare = F.regexp_replace("line", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return lines.where((F.col("line_no") > 0) & ~F.startswith("line", F.lit(credit)) & (bare != marker) & (bare != ""))
