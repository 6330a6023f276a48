"""Dump scan, store, sections, tokens, closure, document: end to end on small inputs of our own."""

import bz2
import random
from collections import deque

import pytest

from lexspark.operators import closure, document, lookup, render, reports, sections, tokens
from lexspark.plans.pipeline import build
from lexspark.sources import dump, store

PAGE = "  <page>\n    <title>{0}</title>\n    <ns>{1}</ns>\n{2}    <revision><text xml:space=\"preserve\">{3}</text></revision>\n  </page>\n"
WIKI = """==French==
# non
==English==
# orphan
===Noun===
# A {{{{lb|en
|old}}}} [[cat]]. Dogs' foe
#: example
## the e.g. [[kitten|Kitten]] &lt;!-- gone --&gt;
===Etymology===
# not kept
# nor this
===VERB===
# to {0}
==German==
# nein"""


def _dump(path, pages, tail=""):
    path.write_bytes(bz2.compress(("<mediawiki>\n  <siteinfo><page-like/></siteinfo>\n" + "".join(PAGE.format(*p) for p in pages) + tail + "</mediawiki>\n").encode()))
    return str(path)


PAGES = [
    ("cat &amp; dog", 0, "", WIKI.format("purr")), ("Cat", 0, '    <redirect title="cat &amp; dog" />\n', "#REDIRECT"), ("Talk:x", 1, "", "English"), ("no", 0, "", "nothing here"),
    ("Template:lb", 10, "", "{{#invoke:labels/templates|show}}"), ("Template:old", 10, '    <redirect title="Template:lb" />\n', "x"), ("Module:labels/data", 828, "", 'labels["old"] = {display = "dated"}\n'), ("empty", 0, "", ""),
]


def test_scan_and_store(spark, tmp_path):
    path = _dump(tmp_path / "d.xml.bz2", PAGES)
    rows = dump.pages(spark, path).orderBy("page_seq").collect()
    assert [(r["title"], r["ns"], r["redirect"]) for r in rows][:3] == [("cat &amp; dog", 0, None), ("Cat", 0, "cat &amp; dog"), ("Talk:x", 1, None)]
    assert len(rows) == 8 and rows[7]["escaped"] == ""
    meta = store.extract(spark, path, str(tmp_path / "dict"))
    assert (meta["entries"], meta["meanings"], meta["redirects"], meta["pages"], meta["all_pages"], meta["main_pages"]) == (1, 3, 1, 3, 8, 4)
    assert meta["sha1"] == dump.digest(path).sha1 and meta["compressed_bytes"] == (tmp_path / "d.xml.bz2").stat().st_size
    d = store.read(spark, str(tmp_path / "dict"), meta["sha1"])
    assert [(r["block_idx"], r["word_type"], r["depth"], r["text"]) for r in d.meanings().orderBy("block_idx", "meaning_idx").collect()] == [(0, "Noun", 1, "A {{lb|en |old}} [[cat]]. Dogs' foe"), (0, "Noun", 2, "the e.g. [[kitten|Kitten]]"), (1, "Verb", 1, "to purr")]
    assert {(r["kind"], r["heading"], r["n"]) for r in d.oddities.collect()} == {("heading", "Etymology", 1), ("orphan", None, 1)}
    assert d.redirects.first().asDict() == {"title": "Cat", "target": "cat & dog"}
    shown = {r["word"]: (r["status"], r["target"]) for r in reports.show(d, spark.createDataFrame([("Cat",), ("cat & dog",), ("zz",)], "word string")).collect()}
    assert shown == {"Cat": ("redirect", "cat & dog"), "cat & dog": ("entry", None), "zz": ("none", None)}
    done = render.render(d.entries, render.library(d))
    assert [m["text"] for b in done.first()["blocks"] for m in b["meanings"]] == ["A (dated) cat. Dogs' foe", "the e.g. Kitten", "to purr"]
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "dict"), "0" * 40)
    with pytest.raises(ValueError):
        store.extract(spark, path, str(tmp_path / "other"), "0" * 40)
    assert not (tmp_path / "other").exists() and [p.name for p in tmp_path.iterdir() if "._" in p.name] == []


def test_split_scan_equals_whole(spark, tmp_path):
    r = random.Random(3)
    pages = [(f"p{i}", r.choice([0, 10, 1]), "", "".join(r.choice("abcdefgh \n") for _ in range(3000))) for i in range(800)]
    path = _dump(tmp_path / "big.xml.bz2", pages)
    whole = dump.pages(spark, path).orderBy("page_seq").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        split = dump.pages(spark, path)
        assert split.rdd.getNumPartitions() > 1
        assert [r["title"] for r in split.orderBy("page_seq").collect()] == [r["title"] for r in whole] == [p[0] for p in pages]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(
    "broken",
    ["  <page>\n    <title>a</title>\n  <page>\n    <ns>0</ns>\n  </page>\n", "  <page>\n    <title>a</title>\n    <ns>zero</ns>\n  </page>\n", "  <page>\n    <ns>0</ns>\n    <text>x</text>\n  </page>\n", "  <page>\n    <title>a</title>\n    <ns>0</ns>\n", "  <page>\n    <title>a</title>\n    <ns>0</ns>\n    <text>x\n  </page>\n"],
)
def test_broken_dumps_fail(spark, tmp_path, broken):
    with pytest.raises(Exception, match="page|namespace|text"):
        dump.kept(dump.pages(spark, _dump(tmp_path / "b.xml.bz2", [], broken))).collect()


def test_two_entries_of_one_title_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="two entries"):
        store.extract(spark, _dump(tmp_path / "d.xml.bz2", [PAGES[0], PAGES[0]]), str(tmp_path / "dict"))


def test_sections_without_english():
    assert sections.sections("==French==\n# x") == ([], [], 0)
    assert sections.sections("==English==\n===noun===\n# a\n===Noun===\n# b\n===X===\n# c\n===X===\n# d")[:2] == ([("Noun", [(1, "a"), (1, "b")])], ["X", "X"])


LINES = ["1. Hello (World of. It) U.S.A. is. New", "don't O'Neil's \\mathcal{A} x—y 'quoted' a.b.", "x ) ( y ] Z! Q", "é́té 3rd 42 -foo bar- snake_case", "", "Mr. X? Yes.No"]


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "id int, text string")
    native = sorted(tuple(r) for r in tokens.token_rows(df, "id").collect())
    assert native == sorted((i, n, w, s) for i, x in enumerate(LINES) for n, (w, s) in enumerate(tokens.py_words(x)))
    assert tokens.py_words("1. The cat (a. B) sat.") == [("The", True), ("cat", False), ("a.", False), ("B", False), ("sat.", True)]


ENTRIES = [
    ("cat", [("Noun", ["A small animal. Dogs' foe", "the e.g. kitten"])]), ("dog", [("Noun", ["animal, well-known"])]), ("animal", [("Noun", ["beast"])]), ("well", [("Adverb", ["good"])]), ("known", [("Adjective", ["known"])]),
    ("small", [("Adjective", ["New York thing"])]), ("New York", [("Proper noun", ["cat"])]), ("e.g.", [("Phrase", ["for"])]), ("noun", [("Noun", ["word of o'neil's co-op"])]), ("'s", [("Clitic", ["x"])]),
]
REDIRECTS = [("Dogs", "dog"), ("dogs", "dog"), ("small", "cat"), ("lost", "nowhere")]


def _fifo(start):
    """The closure one word after another."""
    titles = {t for t, _ in ENTRIES}
    known = {t: t for t in titles} | {a: b for a, b in REDIRECTS if a not in titles and b in titles}

    def whole(w, s):
        low = w[:1].lower() + w[1:]
        tried = [w] if not w[:1].isupper() else [low, w, w.lower()] if s else [w, low, w.lower()]
        return next((known[g] for f in tried for g in (f.replace("’", "'"), f.replace("’", "'").rstrip(".")) if g in known), None)

    def resolve(w, s, out):
        if t := whole(w, s):
            out.append(("entry", t))
            return
        for kind, part, starts in lookup.py_parts(w, s):
            if kind == "token":
                resolve(part, starts, out)
            else:
                out.append(("entry", known[part]) if kind == "clitic" and part in known else ("missing", part))

    order, seen, counts, queue, told = [], set(), {}, deque(), False

    def read(line):
        words = tokens.py_words(line)
        for i, (w, s) in enumerate(words):
            out = []
            spans = [(a, n) for n in (3, 2) for a in range(max(0, i - n + 1), i + 1) if a + n <= len(words)]
            t = whole(w, s) or next((t for a, n in spans if (t := whole(" ".join(x for x, _ in words[a : a + n]), words[a][1]))), None)
            if t:
                out.append(("entry", t))
            else:
                resolve(w, s, out)
            for kind, x in out:
                if (kind, x) not in seen:
                    seen.add((kind, x))
                    order.append((kind, x))
                    if kind == "entry":
                        queue.append(x)
                if kind == "missing":
                    counts[x] = counts.get(x, 0) + 1

    def line(x):
        nonlocal told
        read(x)
        if counts and not told:
            told = True
            read(closure.NOTE)

    for x in start:
        line(x)
    blocks = dict(ENTRIES)
    while queue:
        for kind, texts in blocks[queue.popleft()]:
            line(kind)
            for x in texts:
                line(x)
    return order, counts


def _entries(spark):
    rows = [(t, [{"word_type": k, "meanings": [{"depth": 1 + i % 2, "text": x} for i, x in enumerate(texts)]} for k, texts in blocks]) for t, blocks in ENTRIES]
    return spark.createDataFrame(rows, f"title string, blocks {store.BLOCKS}")


def test_closure_and_document(spark, tmp_path):
    path = tmp_path / "start.txt"
    path.write_text("Name\n\nCredit: x\n\nDefinitions\n\n[definitions]\nThe Cat's text.\n")
    start = dump.start_text(spark, str(path))
    assert [r["line"] for r in start.orderBy("line_no").collect()] == ["Definitions", "The Cat's text."]
    order, counts = _fifo(["Definitions", "The Cat's text."])
    redirects = spark.createDataFrame(REDIRECTS, "title string, target string")
    d = store.Dictionary(_entries(spark), redirects, spark.createDataFrame([], "title string, redirect string, text string"), None, {"sha1": "s"})
    made = build(spark, d, str(path), "CR")
    assert [(r["kind"], r["word"]) for r in made.closure.order.orderBy("ord").collect()] == order
    assert {r["word"]: r["n"] for r in made.closure.missing.collect()} == counts
    out = str(tmp_path / "out")
    document.write_document(made.lines, out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split("\n")
    assert text[:7] == ["Name", "", "Credit: x", "", "CR", "", "Definitions"] and '"cat":' in text
    at = text.index('"cat":')
    assert text[at : at + 5] == ['"cat":', "Noun", "1. A small animal. Dogs' foe", "   1. the e.g. kitten", ""]


def test_numbering(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1, 2, 2, 1, 3, 3, 2, 3],), ([0, 1],), ([],)], "d array<int>").select(document.numbered(F.col("d")).alias("n")).collect()
    assert [r["n"] for r in rows] == [[1, 1, 2, 2, 1, 2, 1, 1], [1, 2], []]


def test_entry_and_queries(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    for name in ("namespace_filter", "closure_reach", "template_freq"):
        assert found[name](spark, sf).count() > 0
