"""What keeps larger tables within bounds: rows over all tasks, work done once, memory of slices."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.markup import expand, parser
from lexspark.functions.markup.expand import Expander, Library
from lexspark.operators import render, tokens
from lexspark.plans import queries
from lexspark.sources import dump, store


def _tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["module_functions", "string_fns", "form_of", "parser_words", "transclusion", "parser_functions", "plain_text"])
def test_one_row_group_is_rendered_by_many_tasks(spark, sf, name):
    assert _tasks_with_rows(queries.QUERIES[name](spark, sf)) > 4


def test_render_deals_entries(spark):
    rows = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("title"), F.lit(None).cast(store.BLOCKS).alias("blocks"))
    assert _tasks_with_rows(render.render(rows, Library())) > 4


def test_blocks_keep_their_shape(spark):
    rows = [(str(i), None if i % 5 == 0 else [{"word_type": f"w{j}", "meanings": None if j == 1 else [{"depth": k, "text": None if k == 2 else f"'''x{i}''' {{{{no{k}}}}}"} for k in range(i % 4)]} for j in range(i % 3)]) for i in range(2500)]
    known = Library()
    done = {r["title"]: r for r in render.render(spark.createDataFrame(rows, f"title string, blocks {store.BLOCKS}").coalesce(1), known, spread=False).collect()}
    assert len(done) == len(rows)
    for title, blocks in rows:
        e, noted = Expander(known), []
        for m in (m for b in blocks or [] for m in b["meanings"] or []):
            m["text"], found = e.render(title, m["text"] or "")
            noted += found
        assert done[title].asDict(True) == {"title": title, "blocks": blocks, "events": [{"kind": k, "key": v} for k, v in noted]}


def test_calls_are_expanded_once(monkeypatch):
    pages = [("Template:lb", None, "{{#invoke:labels/templates|show}}"), ("Template:me", None, "{{PAGENAME}}"), ("Template:pn", None, "{{#invoke:pages/templates|pagename_t}}"), ("Template:f", None, "{{#invoke:no|such}}")]
    ran = []
    show = expand.MODULE_FUNCTIONS["labels/templates|show"]
    monkeypatch.setitem(expand.MODULE_FUNCTIONS, "labels/templates|show", lambda c: ran.append(1) or show(c))
    e = Expander(Library.of_pages(pages))
    for title in ("a", "b", "c"):
        assert e.render(title, "{{lb|en|x}} {{me}} {{pn}} {{f|1|2}} {{gone}}") == (f"(x) {title} {title} 2", [("fallback", "no|such"), ("missing", "Template:gone")])
    assert len(ran) == 1


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(expand, "REMEMBERED", 50)
    monkeypatch.setattr(parser, "REMEMBERED", 50)
    e = Expander(Library.of_pages([("Template:x", None, "{{{1}}}")]))
    for i in range(500):
        assert e.render("t", f"{{{{x|{i}}}}} {{{{none {i}}}}} [[l{i}]]")[0] == f"{i} l{i}"
        assert max(map(len, (e.trees, e.names, e.results, parser._simple))) <= 50
    long = "y" * 5000
    assert e.render("t", f"{{{{x|{long}}}}}")[0] == long and f"{{{{x|{long}}}}}" not in parser._simple


def test_simple_nodes_are_those_of_the_full_parse(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(["{{", "}}", "{{{", "}}}", "[[", "]]", "|", "=", "a", "\n", "<ref>", "</ref>", "<t:", "<NoWiki/>", ">", "{", "]", " b "]) for _ in range(r.randrange(25))) for _ in range(6000)]
    quick = [parser.parse(t) for t in texts]
    plainly = {k: parser.re.compile(v.pattern.replace(f"({parser._SIMPLE})", "((?!))")) for k, v in parser._STOPS.items()}
    monkeypatch.setattr(parser, "_STOPS", plainly)
    assert type(parser.parse("{{a}}")[0]) is tuple
    assert quick == [parser.parse(t) for t in texts]


def test_other_tags_keep_a_node_simple():
    assert type(parser.parse("{{form of|en|a<t:b>,c<gloss:d>}}")[0]) is parser.Simple
    assert type(parser.parse("{{l|a<ref>}}</ref>}}")[0]) is not parser.Simple


def test_words_of_many_lines_are_not_python_objects_at_once():
    lines = [f"The {i}th line (of. many) words. Ends" if i % 7 else None if i % 2 else "" for i in range(10_000)]
    given = pa.array(lines)
    tracemalloc.start()
    found = tokens._word_arrays(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20  # all of them: over 10 MB
    assert found.to_pylist() == [None if t is None else [{"word": w, "sentence_start": s} for w, s in tokens.py_words(t)] for t in lines]
    assert tokens._word_arrays(given.slice(9_990, 0)).to_pylist() == []


def test_word_array_of_a_column(spark):
    rows = spark.createDataFrame([(1, "A b. C"), (2, None), (3, "")], "id int, t string").select("id", tokens.word_array(F.col("t")).alias("w")).collect()
    assert {r["id"]: None if r["w"] is None else [tuple(x) for x in r["w"]] for r in rows} == {1: [("A", True), ("b.", False), ("C", True)], 2: None, 3: []}


def test_filters_on_pages_work_their_columns_out_once(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki>\n</mediawiki>\n")
    found = dump.decoded(dump.routed(dump.kept(dump.pages(spark, str(tmp_path / "d.xml")))).where("kind <> 'dropped'"), "title", "escaped").select("title", "kind", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<ns>") == 1 and plan.count("a page inside a page") == 1


def test_odd_pages(spark, tmp_path):
    head = "<page>\n<title>{0}</title>\n<ns>0</ns>\n"
    bodies = ["<text>a</text>", '<text bytes="0" />', "<text/>", '<text x="y">a &gt; b > c</text>', "<text>a</text>x<text q='/'>b</text>", "<text>a</text></text>", "", "<text></text>", "<text/></text>"]
    pages = [head.format(i) + b + "\n</page>\n" for i, b in enumerate(bodies)]
    (tmp_path / "d.xml").write_text("<mediawiki>\n<a><page></a>\n".replace("<page>", "<pages>") + "".join(pages) + "  <page>\r\n<title>crlf</title>\r\n<ns>10</ns>\r\n</page>\n</mediawiki>\n")
    rows = dump.pages(spark, str(tmp_path / "d.xml")).orderBy("page_seq").collect()
    assert [r["escaped"] for r in rows] == ["a", "", "", "a &gt; b > c", "ab", "a", "", "", "", ""]
    assert [(r["title"], r["ns"]) for r in rows] == [(str(i), 0) for i in range(len(bodies))] + [("crlf", 10)]


def test_references_decoded_in_both_ways(spark):
    r = random.Random(9)
    texts = [None, ""] + ["".join(r.choice(["&", "amp;", "lt;", "gt;", "quot;", "apos;", "#65;", "#x", ";", "a", "&amp;", "é"]) for _ in range(r.randrange(12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.xml_text(F.col("t")).alias("x")).collect()
    assert all(row["x"] == (None if row["t"] is None else T.xml_unescape(row["t"])) for row in rows) and len(rows) == len(texts)
