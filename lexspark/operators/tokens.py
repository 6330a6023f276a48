"""Words of running text, with whether each starts a sentence.

``token_rows`` is native: events of a line are found by one regular expression and the state (bracket
depth, sentence start) is worked out by windows over them. ``word_array`` gives the same as an
array per line from an Arrow UDF, without a shuffle; the look-up of whole dictionaries uses it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE

_WORD = r"[\p{IsAlphabetic}\p{N}][\p{IsAlphabetic}\p{N}'’.\-\x{0300}-\x{036F}]*"
_EVENT = rf"\\?{_WORD}(?:\p{{IsWhite_Space}}|\z)?|[(\[)\]]|[.!?](?=\p{{IsWhite_Space}}|\z)"
#: Lines whose words are Python objects at once.
SLICE = 100
WORD_ARRAY = "array<struct<word string, sentence_start boolean>>"


def words(text: Column) -> Column:
    """Lower-case words of a text as an array, without the punctuation that may end them; native."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))
    return F.transform(found, lambda w: F.regexp_replace(w, r"['’.\-]+$", ""))


def token_rows(lines: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """key, pos int, word, sentence_start boolean: every word of each line (unique key) in reading order."""
    keys = [key] if isinstance(key, str) else key
    events = lines.select(*keys, F.posexplode(F.regexp_extract_all(F.concat(F.col(text), F.lit("\n")), F.lit(f"({_EVENT})"), F.lit(1))).alias("p", "ev"))
    core = F.regexp_replace("ev", r"\p{IsWhite_Space}$", "")
    is_word = F.rlike(core, F.lit(r"^\\?[\p{IsAlphabetic}\p{N}]"))
    events = events.select(
        *keys,
        "p",
        F.regexp_replace(core, r"['’\-]+$", "").alias("word"),
        (is_word & ~F.startswith(core, F.lit("\\")) & F.rlike(F.regexp_replace(core, r"['’\-]+$", ""), F.lit(r"\p{IsAlphabetic}"))).alias("emit"),
        F.when(is_word, F.endswith(core, F.lit(".")) & (F.length("ev") > F.length(core))).otherwise(F.rlike(core, F.lit("^[.!?]"))).alias("term"),
        F.when(is_word, 0).when(core.isin("(", "["), 1).when(core.isin(")", "]"), -1).otherwise(0).alias("dx"),
    )
    w = Window.partitionBy(*keys).orderBy("p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    depth = events.withColumn("s", F.sum("dx").over(w))
    depth = depth.withColumn("d", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    state = depth.withColumn("last_term", F.max(F.when(F.col("term"), F.col("p"))).over(before)).withColumn("last_word", F.max(F.when(F.col("emit") & (F.col("d") == 0), F.col("p"))).over(before))
    start = (F.col("d") == 0) & (F.col("last_word").isNull() | F.coalesce(F.col("last_term") >= F.col("last_word"), F.lit(False)))
    return state.where("emit").select(*keys, (F.row_number().over(w) - 1).alias("pos"), "word", start.alias("sentence_start"))


# -- Python ------------------------------------------------------------------------------------


def _continues(c: str) -> bool:
    return c.isalnum() or c in "'’-." or "\u0300" <= c <= "\u036f"


_PIECES = re.compile(r"[^\W_][\w'’.\-\u0300-\u036f]*|[()\[\].!?]")


def py_words(line: str) -> list[tuple[str, bool]]:
    """(word, sentence_start) of each word of a line."""
    out: list[tuple[str, bool]] = []
    start, depth, at = True, 0, 0
    ends = lambda i: i >= len(line) or line[i] in WHITE
    while m := _PIECES.search(line, at):
        at = m.end()
        if not m[0][0].isalnum():
            depth = max(0, depth + (m[0] in "([") - (m[0] in ")]"))
            start |= m[0] in ".!?" and ends(at)
            continue
        raw = m[0]
        if cut := next((i for i, c in enumerate(raw) if not _continues(c)), 0):  # \w has the underscore too
            raw, at = raw[:cut], m.start() + cut
        word = raw.rstrip("'’-")
        formula = line[m.start() - 1 : m.start()] == "\\" if m.start() else False
        if not formula and any(c.isalpha() for c in word):
            out.append((word, start and not depth))
            start &= depth > 0
        start |= raw.endswith(".") and ends(at)
    return out


def _word_arrays(texts: pa.Array) -> pa.Array:
    """The words of lines as an Arrow list array; a slice of the lines at a time is Python objects."""
    done = [_sliced(texts.slice(at, SLICE)) for at in range(0, max(1, len(texts)), SLICE)]
    return pa.concat_arrays(done)


def _sliced(texts: pa.Array) -> pa.Array:
    found, starts, ends = [], [], [0]
    for text in texts:
        for word, start in py_words(text.as_py() or ""):
            found.append(word)
            starts.append(start)
        ends.append(len(found))
    words = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.bool_())], ["word", "sentence_start"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words, mask=texts.is_null())


def word_array(text: Column) -> Column:
    """The words of a line as WORD_ARRAY; null for null."""
    return F.arrow_udf(_word_arrays, WORD_ARRAY)(text)
