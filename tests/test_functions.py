"""Text functions, Lua literals, markup: rules by example and by brute force."""

import html
import random

import pytest

from lexspark.functions import text as T
from lexspark.functions.lua import Table, assigned_table, assignments, strings
from lexspark.functions.markup.expand import Expander, Library
from lexspark.functions.markup.parser import parse, split_named, transcluded
from lexspark.functions.markup.plain import plain


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("a &lt;b&gt; &amp;amp; &quot;x&apos;", "a <b> &amp; \"x'"), ("&#65;&#x41;&#X42;", "AAB"), ("&nope; & &;", "&nope; & &;"), ("&#1114112;&#55296;", "&#1114112;&#55296;"), ("&#0000000065;", "&#0000000065;"), ("é&#233;ééé&amp;", "ééééé&"), ("&a&lt;", "&a<")],
)
def test_unescape(given, wanted):
    assert T.xml_unescape(given) == wanted


def test_unescape_undoes_escape():
    r = random.Random(1)
    for _ in range(200):
        s = "".join(r.choice("<>&\"'aé;#x ") for _ in range(20))
        assert T.xml_unescape(html.escape(s, quote=False)) == s


def test_native_and_python_agree(spark):
    from pyspark.sql import functions as F

    texts = ["&lt;a&gt; &amp;lt;", "x <!-- y --> z <!-- w", "", "a , b ( c ) ()", "=== N ===", "##: x", "## y ", "[['Apple", " pear "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.named_entities(F.col("t")).alias("e"), T.strip_comments(F.col("t")).alias("c"), T.article(F.col("t")).alias("a"), T.heading(F.col("t")).alias("h"), T.meaning_line(F.col("t")).alias("m"), T.trim(F.col("t")).alias("s")).collect()
    from lexspark.operators.sections import heading, meaning

    for r in rows:
        assert r["e"] == T.xml_unescape(r["t"])
        assert r["c"] == T.py_strip_comments(r["t"])
        assert r["a"] == T.py_article(r["t"])
        assert (tuple(r["h"]) if r["h"] else None) == heading(r["t"])
        assert (tuple(r["m"]) if r["m"] else None) == meaning(r["t"])
        assert r["s"] == T.py_strip(r["t"])


def test_lua():
    source = """-- t["off"] = 1
t["a"] = {display = "A \\"q\\" \\065", aliases = {"x", y, "z"}, flag = true, n = 1.5, -- note
  [ [[k]] ] = [==[
long]==], nil_call = f(1, {"}"}), "p"}
t["b"] = f(x)
t["c"] = "s" .. "t"
t["d"] = 'one'
 t["indented"] = 1
t["e"] = "bad \\z"
u.v = { a = 1, ["b"] = "B"; "c" }
"""
    found, skipped = assignments(source, "t")
    assert [k for k, _ in found] == ["a", "d"] and skipped == 3
    a = found[0][1]
    assert a.get("display") == 'A "q" A' and strings(a.get("aliases")) == ["x", "z"] and a.truthy("flag") and a.get("n") == 1.5
    assert a.get("k") == "long" and a.get("nil_call") is None and a.positional() == ["p"]
    assert assigned_table(source, "u.v") == Table([("a", 1.0), ("b", "B"), (None, "c")])
    assert assigned_table(source, "w") is None


def test_parse():
    assert parse("a{{b|c=d|{{{e|f}}}}}[[g|h]]") == ["a", ("template", [["b"], ["c=d"], [("parameter", [["e"], ["f"]])]]), ("link", [["g"], ["h"]])]
    assert parse("a {{b") == ["a {{b"] and parse("{{{a}}") == ["{", ("template", [["a"]])]
    assert parse("[[a], [[b]]") == ["[[a], ", ("link", [["b"]])]
    assert parse("{{a|<nowiki>|}}</nowiki>}}") == [("template", [["a"], [("sealed", "<nowiki>|}}</nowiki>")]])]
    assert split_named(["a", ("template", []), "b=c=d"]) == (["a", ("template", []), "b"], ["c=d"])
    assert parse("{{" * 200 + "x") == ["{{" * 200 + "x"]
    assert transcluded("a<noinclude>b</noinclude>c<!-- d --><includeonly>e</includeonly>") == "ace"
    assert transcluded("a<onlyinclude>b</onlyinclude>c<onlyinclude>d") == "bd"


PAGES = [
    ("Template:lb", None, "{{#invoke:labels/templates|show}}"), ("Template:lbl", "Template:lb", ""), ("Template:loop", None, "{{loop}}"), ("Template:go", "Template:go", ""),
    ("Template:echo", None, "{{{1|none}}}/{{{n|}}}/{{{zz}}}"), ("Template:place", None, "{{#invoke:place|show}}"), ("Template:f", None, "{{#invoke:no|such}}"),
    ("Module:labels/data/lang/en", None, 'labels["first"] = {display = "one"}\n'), ("Module:labels/data", None, 'labels["first"] = {display = "two"}\nlabels["_"] = {display = "", omit_preComma = true, omit_postComma = true}\n'),
    ("Module:place/placetypes", None, 'export.placetype_aliases = { c = "country", co = "county", obl = "oblast" }\n'),
]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("{{lb|en|first|_|late}} x", "(one late) x"),
        ("{{lbl|en|a|b}} [[Dog#Noun|dogs]] [[w:Cat]] [[Category:X]][[:Category:Y]]", "(a, b) dogs Cat Category:Y"),
        ("{{echo|a b|n= c }} {{echo}} {{ echo | x }}", "a b/c/{{{zz}}} none//{{{zz}}} x //{{{zz}}}"),
        ("{{#if:|a|b}}{{#if:x|a}}{{#ifeq:1|01|y|n}}{{#ifeq:a|b|y|n}}{{#ifexist:Template:lb|e|m}}", "bayne"),
        ("{{#switch:b|a|b=1|c=2}}{{#switch:q|a=1|other}}{{#switch:q|#default=d|a=1}}", "1otherd"),
        ("'''b''' ''i'' &nbsp;x &shy;y&mdash;z 5<sup>th</sup>c <ref name=x/>a<ref>{{f}}</ref>b<br>c", "b i x y—z 5th c ab c"),
        ("[http://x.y label] [http://x.y] ( a ) ()", "label (a)"),
        ("{{place|en|village|obl/Kyiv|c/Ukraine|capital=x}}", "A village in Kyiv Oblast, Ukraine. Capital: x"),
        ("{{place|en|city|c/United States}} {{place|en|co|co/Kent|c/UK}}", "A city in the United States A county in Kent, United Kingdom"),
        ("{{place|en|a <<town>> in <<co/Kent>>|c/UK}} {{place|en|town/seat|of|co/X}}", "a town in Kent, United Kingdom A town, the seat of of X County"),
        ("{{uc:é}}{{ucfirst:ab}}{{lc:AB}}{{PAGENAME}}{{CURRENTMONTHNAME}}", "ÉAbabtOctober"),
    ],
)
def test_render(text, wanted):
    assert Expander(Library.of_pages(PAGES)).render("t", text)[0] == wanted


def test_events():
    e = Expander(Library.of_pages(PAGES))
    assert e.render("t", "{{f|a|b}} {{nope}} {{rfdef|en}} {{go}}")[1] == [("fallback", "no|such"), ("missing", "Template:nope"), ("maintenance", "rfdef"), ("missing", "Template:go")]
    assert e.render("t", "{{loop}}")[1] == [("depth", "")]


def test_plain_keeps_what_is_no_markup():
    assert plain("a < b [c] & d {{e}} 3<4") == "a < b [c] & d {{e}} 3<4"
