"""From words to dictionary entries: candidate forms, phrases and parts, as joins.

A resolved token costs joins on the distinct (word, sentence_start) pairs alone, however often it is
met; nothing is broadcast but by Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that are looked up for themselves, in the order in which they are tried.
CLITICS = ("'s", "'ll", "'re", "'ve", "'d", "'m", "n't")
PARTS = "array<struct<kind string, part string, sentence_start boolean>>"
ROUNDS = 64


def forms(token: Column, sentence_start: Column) -> Column:
    """The forms to try, in order: capitals as the place asks for, curly apostrophes straightened, with and without final stops."""
    lower_first = F.concat(F.lower(F.substring(token, 1, 1)), F.substring(token, F.lit(2), F.length(token)))
    upper = F.rlike(token, F.lit(r"^\p{IsUppercase}"))
    tried = F.when(~upper, F.array(token)).when(sentence_start, F.array(lower_first, token, F.lower(token))).otherwise(F.array(token, lower_first, F.lower(token)))
    pairs = F.transform(tried, lambda f: F.array(F.replace(f, F.lit("’"), F.lit("'")), F.nullif(F.regexp_replace(F.replace(f, F.lit("’"), F.lit("'")), r"\.+$", ""), F.lit(""))))
    return F.array_distinct(F.filter(F.flatten(pairs), lambda f: f.isNotNull()))


def known_forms(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(form, title): titles themselves, and redirects of one hop to a title from what is none."""
    own = titles.select(F.col("title").alias("form"), "title")
    hops = redirects.select(F.col("title").alias("form"), F.col("target").alias("title")).join(titles.select("title"), "title", "left_semi").join(titles.select(F.col("title").alias("form")), "form", "left_anti")
    return own.union(hops.select("form", "title"))


def first_match(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys and title of the first of each key's candidates (form, rank) that is known."""
    return candidates.join(known, "form").groupBy(*keys).agg(F.min_by("title", "rank").alias("title"))


def whole(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(word, sentence_start, title) of the distinct tokens that are entries as a whole."""
    rows = tokens.select("word", "sentence_start").distinct()
    candidates = rows.select("word", "sentence_start", F.posexplode(forms(F.col("word"), F.col("sentence_start"))).alias("rank", "form"))
    return first_match(candidates, known, ["word", "sentence_start"])


def phrases(lines: DataFrame, keys: list[str], known: DataFrame, found: DataFrame) -> DataFrame:
    """keys, tok, title of tokens without an entry that are in a phrase of three or two words which has one.

    ``lines`` has keys and words (see tokens.WORD_ARRAY): three words first, leftmost first.
    """
    tokens = lines.select(*keys, "words", F.posexplode("words").alias("tok", "t"))
    lost = tokens.join(found.select(F.col("word").alias("_w"), F.col("sentence_start").alias("_s")), (F.col("t.word") == F.col("_w")) & (F.col("t.sentence_start") == F.col("_s")), "left_anti")
    spans = F.filter(
        F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("n"), (F.col("tok") - back).alias("start")) for i, (n, back) in enumerate(((3, 2), (3, 1), (3, 0), (2, 1), (2, 0)))]),
        lambda x: (x["start"] >= 0) & (x["start"] + x["n"] <= F.size("words")),
    )
    windows = lost.select(*keys, "tok", "words", F.explode(spans).alias("w")).select(
        *keys, "tok", "w.place", F.array_join(F.transform(F.slice("words", F.col("w.start") + 1, F.col("w.n")), lambda x: x["word"]), " ").alias("phrase"), F.get("words", F.col("w.start"))["sentence_start"].alias("sentence_start")
    )
    candidates = windows.select(*keys, "tok", "place", F.posexplode(forms(F.col("phrase"), F.col("sentence_start"))).alias("order", "form"))
    return first_match(candidates.withColumn("rank", F.struct("place", "order")), known, [*keys, "tok"])


def py_parts(token: str, sentence_start: bool) -> list[tuple[str, str, bool]]:
    """What a token without an entry falls into: (kind, part, sentence_start), kind token, clitic or missing."""
    base = token.replace("’", "'").rstrip(".")
    letters = lambda s: any(c.isalpha() for c in s)
    for clitic in CLITICS:
        stem = base.removesuffix(clitic)
        if stem != base and letters(stem) and not stem.endswith("'"):
            return [("token", stem, sentence_start), ("clitic", clitic, False)]
    for mark in "-.'":
        if mark in base:
            parts = [p for p in base.split(mark) if letters(p)]
            return [("token", p, sentence_start and i == 0) for i, p in enumerate(parts)]
    if sentence_start:
        base = (token[:1].lower() + token[1:] if token[:1].isupper() else token).replace("’", "'")
    return [("missing", base.rstrip("."), False)]


def parts(tokens: DataFrame, known: DataFrame, keep) -> DataFrame:
    """(word, sentence_start, path, kind, target) of distinct tokens without an entry: entries and missing words.

    Parts without an entry of their own fall apart again, a level of joins for all tokens at a
    time. Each level makes parts shorter, so there are as many as the longest word has joints.
    ``keep`` cuts the lineage of a level.
    """
    split = F.udf(lambda w, s: [{"kind": k, "part": p, "sentence_start": t} for k, p, t in py_parts(w, s)], PARTS, useArrow=True)
    left = tokens.select("word", "sentence_start", F.col("word").alias("part"), F.col("sentence_start").alias("starts"), F.array().cast("array<int>").alias("path"))
    done: DataFrame | None = None
    for level in range(ROUNDS):
        fell = left.select("word", "sentence_start", "path", F.posexplode(split("part", "starts")).alias("i", "x")).select("word", "sentence_start", F.concat("path", F.array("i")).alias("path"), "x.kind", "x.part", F.col("x.sentence_start").alias("starts"))
        fell = keep(fell)
        whole_parts = fell.where("kind = 'token'").select(F.col("part").alias("word"), F.col("starts").alias("sentence_start"))
        titles = whole(whole_parts, known).select(F.col("word").alias("part"), F.col("sentence_start").alias("starts"), "title")
        asked = fell.where("kind = 'token'").join(titles, ["part", "starts"], "left")
        clitics = fell.where("kind = 'clitic'").join(known.select(F.col("form").alias("part"), "title"), "part", "left")
        out = fell.where("kind = 'missing'").select("word", "sentence_start", "path", "kind", F.col("part").alias("target"))
        out = out.union(clitics.select("word", "sentence_start", "path", F.when(F.col("title").isNull(), "missing").otherwise("entry"), F.coalesce("title", "part")))
        out = keep(out.union(asked.where("title IS NOT NULL").select("word", "sentence_start", "path", F.lit("entry"), "title")))
        done = out if done is None else done.union(out)
        left = keep(asked.where("title IS NULL").select("word", "sentence_start", "part", "starts", "path"))
        if left.isEmpty():
            return done
    raise RuntimeError("a word has more joints than there are rounds")


def edges(lines: DataFrame, known: DataFrame, keep) -> DataFrame:
    """parent, line, tok, path, kind, target: where each line (parent, line, words) leads, in reading order."""
    tokens = lines.select("parent", "line", F.posexplode("words").alias("tok", "t")).select("parent", "line", "tok", "t.word", "t.sentence_start")
    found = keep(whole(tokens, known))
    joined = tokens.join(found, ["word", "sentence_start"], "left")
    direct = joined.where("title IS NOT NULL").select("parent", "line", "tok", F.array().cast("array<int>").alias("path"), F.lit("entry").alias("kind"), F.col("title").alias("target"))
    in_phrase = keep(phrases(lines, ["parent", "line"], known, found))
    by_phrase = in_phrase.select("parent", "line", "tok", F.array().cast("array<int>"), F.lit("entry"), "title")
    lost = joined.where("title IS NULL").drop("title").join(in_phrase.select("parent", "line", "tok"), ["parent", "line", "tok"], "left_anti")
    fallen = parts(lost.select("word", "sentence_start").distinct(), known, keep)
    by_parts = lost.join(fallen, ["word", "sentence_start"]).select("parent", "line", "tok", "path", "kind", "target")
    return direct.union(by_phrase).union(by_parts)
