"""Rendering of whole dictionaries: every meaning's markup to plain text, with events to count."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup.expand import Dates, Expander, Library
from ..functions.text import leftover_markup
from ..sources.store import BLOCKS, Dictionary, flat
from .closure import checkpointed  # noqa: F401  for callers that render once and read twice

#: Most bytes of template and module pages, and of titles, that are sent to every task.
LIBRARY_BYTES = 512 << 20
#: Tasks a core that rows are dealt to, and entries whose texts a task holds at once.
TASKS_PER_CORE = 3
SLICE = 1000


def library(dictionary: Dictionary, dates: Dates | None = None, most: int = LIBRARY_BYTES) -> Library:
    """What rendering needs, of a checked size: templates, data tables and, if #ifexist is used, all titles."""
    pages = dictionary.pages
    size, asks = pages.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("title")), F.lit(0)), F.coalesce(F.bool_or(F.contains("text", F.lit("#ifexist"))), F.lit(False))).first()
    if size > most:
        raise ValueError(f"templates and modules have {size} bytes; the bound is {most}")
    titles: list[str] = []
    meanings = F.exists("blocks", lambda b: F.exists(b["meanings"], lambda m: F.contains(m["text"], F.lit("#ifexist"))))
    if asks or not dictionary.entries.where(meanings).limit(1).isEmpty():
        every = all_titles(dictionary)
        size = every.agg(F.coalesce(F.sum(F.octet_length("title")), F.lit(0))).first()[0]
        if size > most:
            raise ValueError(f"titles have {size} bytes; the bound is {most}")
        titles = [r[0] for r in every.toLocalIterator()]
    rows = ((r["title"], r["redirect"], r["text"]) for r in pages.select("title", "redirect", "text").toLocalIterator())
    return Library.of_pages(rows, titles, dates)


def all_titles(dictionary: Dictionary) -> DataFrame:
    """Every title that exists: entries, redirects, pages."""
    return dictionary.entries.select("title").union(dictionary.redirects.select("title")).union(dictionary.pages.select("title")).distinct()


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by these keys to a few tasks a core, as a scan's row groups may be fewer than the cores."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def render(entries: DataFrame, known: Library, spread: bool = True) -> DataFrame:
    """title, blocks with plain texts (empty meanings included), events array<struct<kind, key>> of entries (title, blocks).

    Entries are dealt by title first; callers that have dealt narrower rows leave this out (``spread``).
    """
    shared = entries.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expander = Expander(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                title = piece.column("title")
                yield pa.RecordBatch.from_arrays([title, *_rendered(expander, title.to_pylist(), piece.column("blocks"))], ["title", "blocks", "events"])

    rows = entries.select("title", "blocks")
    return (dealt(rows, "title") if spread else rows).mapInArrow(run, f"title string, blocks {BLOCKS}, events array<struct<kind: string, key: string>>")


def _sizes(lists: pa.Array) -> list[int]:
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of these sizes, nulls and type with other values."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(_sizes(like))], pa.int32()), values, type=like.type, mask=like.is_null())


def _rendered(expander: Expander, titles: list[str], blocks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Blocks with their texts rendered, and the events of each row; only texts become Python objects."""
    inner = blocks.flatten()
    lists = inner.field("meanings")
    meanings = lists.flatten()
    texts, sizes = iter(meanings.field("text").to_pylist()), iter(_sizes(lists))
    out, kinds, keys, ends = [], [], [], [0]
    for title, n in zip(titles, _sizes(blocks), strict=True):
        for text in islice(texts, sum(islice(sizes, n))):
            text, found = expander.render(title, text or "")
            out.append(text)
            for kind, key in found:
                kinds.append(kind)
                keys.append(key)
        ends.append(len(kinds))
    meanings = pa.StructArray.from_arrays([pa.array(out, f.type) if f.name == "text" else meanings.field(f.name) for f in meanings.type], fields=list(meanings.type))
    inner = pa.StructArray.from_arrays([_lists(lists, meanings) if f.name == "meanings" else inner.field(f.name) for f in inner.type], fields=list(inner.type))
    noted = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string())], ["kind", "key"])
    return _lists(blocks, inner), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), noted)


def defined(rendered: DataFrame) -> DataFrame:
    """title and blocks without empty meanings, word types without meanings, entries without word types."""
    full = F.transform("blocks", lambda b: F.struct(b["word_type"].alias("word_type"), F.filter(b["meanings"], lambda m: m["text"] != "").alias("meanings")))
    return rendered.select("title", F.filter(full, lambda b: F.size(b["meanings"]) > 0).alias("blocks")).where(F.size("blocks") > 0)


def events(rendered: DataFrame) -> DataFrame:
    """kind, key, title: one row per event."""
    return rendered.select("title", F.explode("events").alias("e")).select("e.kind", "e.key", "title")


def quality(rendered: DataFrame) -> DataFrame:
    """One row: lines, empty, leftover (lines with markup left), depth_exceeded."""
    lines = flat(rendered.select("title", "blocks")).agg(F.count("*").alias("lines"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(leftover_markup(F.col("text"))).alias("leftover"))
    deep = events(rendered).agg(F.count_if(F.col("kind") == "depth").alias("depth_exceeded"))
    return lines.crossJoin(deep)
