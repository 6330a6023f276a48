"""The flagship plan: a dictionary and a start text become a document of all words it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import closure, document, render
from ..operators.closure import checkpointed
from ..sources import dump
from ..sources.store import Dictionary


@dataclass(frozen=True)
class Built:
    rendered: DataFrame
    closure: closure.Closure
    lines: DataFrame


def build(spark: SparkSession, dictionary: Dictionary, start_path: str, credit: str) -> Built:
    """Render all entries, close the start text over them, and lay the document out."""
    rendered = checkpointed(render.defined(render.render(dictionary.entries, render.library(dictionary))))
    closed = closure.close(spark, rendered, dictionary.redirects, dump.start_text(spark, start_path))
    whole = spark.read.text(start_path, wholetext=True).first()
    text = [x.removesuffix("\r") for x in (whole["value"] if whole else "").removesuffix("\n").split("\n")]
    return Built(rendered, closed, document.document(spark, text, closed.order, rendered, credit))
