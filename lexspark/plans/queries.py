"""Queries over the test tables, one per operator, each with DuckDB SQL for the same rows.

The tables hold no wiki markup, so markup operators get texts made from columns, for which the
right result is a closed form. Operators are called as a user would call them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lua import Table, assigned_table, assignments
from ..functions.markup.expand import Library
from ..operators import closure, document, lookup, render, reports, sections, tokens
from ..sources import dump, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered_texts(rows: DataFrame, known: Library, title: str, text: Column, *keys: str) -> DataFrame:
    """keys and rendered text of rows: each as an entry with one meaning. Rows are dealt out before texts are made of them."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    entries = render.dealt(rows, *keys).select(F.to_json(F.struct(F.col(title).alias("title"), *keys)).alias("title"), _one_meaning(text).alias("blocks"))
    done = render.render(entries, known, spread=False)
    return done.select(F.from_json("title", types).alias("k"), F.col("blocks")[0]["meanings"][0]["text"].alias("text")).select("k.*", "text")


def _one_meaning(text: Column) -> Column:
    meaning = F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), text.alias("text")))
    return F.array(F.struct(F.lit("").alias("word_type"), meaning.alias("meanings")))


# -- words -------------------------------------------------------------------------------------


@query(r"""
    WITH w AS (SELECT regexp_replace(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{M}\p{N}''’.\-]*')), '[''’.\-]+$', '') AS word FROM documents),
    c AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT sum(n) AS total FROM c)
    SELECT CAST(row_number() OVER o AS INT) AS rank, word, n, CAST(sum(n) OVER o AS BIGINT) AS running, 100.0 * CAST(sum(n) OVER o AS DOUBLE) / total AS share
    FROM c, t WINDOW o AS (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) QUALIFY row_number() OVER o <= 200""")
def token_top_share(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tokens.words(F.col("text"))).alias("word"))
    return reports.running_share(reports.counted(words, "word"), "word", 200)


@query(r"""
    WITH ev AS (SELECT conv_id, turn, unnest(e) AS ev, generate_subscripts(e, 1) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text || chr(10),
        '\\?[\p{L}\p{N}][\p{L}\p{M}\p{N}''’.\-]*\s?|[(\[)\]]|[.!?]\s') AS e FROM conversations)),
    c AS (SELECT *, regexp_replace(ev, '\s$', '') AS core, regexp_matches(ev, '^\\?[\p{L}\p{N}]') AS is_word FROM ev),
    t AS (SELECT *, regexp_replace(core, '[''’\-]+$', '') AS word,
        is_word AND NOT starts_with(core, '\') AND regexp_matches(regexp_replace(core, '[''’\-]+$', ''), '\p{L}') AS emit,
        CASE WHEN is_word THEN ends_with(core, '.') AND length(ev) > length(core) ELSE regexp_matches(core, '^[.!?]') END AS term,
        CASE WHEN is_word THEN 0 WHEN core IN ('(', '[') THEN 1 WHEN core IN (')', ']') THEN -1 ELSE 0 END AS dx FROM c),
    s AS (SELECT *, sum(dx) OVER w AS s FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY p)),
    d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id, turn ORDER BY p)) AS d FROM s),
    l AS (SELECT *, max(CASE WHEN term THEN p END) OVER b AS last_term, max(CASE WHEN emit AND d = 0 THEN p END) OVER b AS last_word
        FROM d WINDOW b AS (PARTITION BY conv_id, turn ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS INT) AS pos, word,
        d = 0 AND (last_word IS NULL OR coalesce(last_term >= last_word, false)) AS sentence_start FROM l WHERE emit""")
def tokens_sentence_start(spark, sf_dir):
    return tokens.token_rows(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query(ORACLES["tokens_sentence_start"])
def word_arrays(spark, sf_dir):
    """The words of whole lines, as the closure's lines have them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens.word_array(F.col("text"))).alias("pos", "w"))
    return rows.select("conv_id", "turn", "pos", "w.*")


@query(r"""
    WITH w AS (SELECT regexp_replace(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{M}\p{N}''’.\-]*')), '[''’.\-]+$', '') AS word FROM documents),
    c AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT sum(n) AS total FROM c)
    SELECT CAST(row_number() OVER o AS INT) AS rank, word, n, CAST(sum(n) OVER o AS BIGINT) AS running, 100.0 * CAST(sum(n) OVER o AS DOUBLE) / total AS share
    FROM c, t WINDOW o AS (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING)""")
def token_share(spark, sf_dir):
    """Running shares of all words, without one task that ranks them."""
    words = table(spark, sf_dir, "documents").select(F.explode(tokens.words(F.col("text"))).alias("word"))
    return reports.running_share(reports.counted(words, "word"), "word")


# -- scan, router, filters ---------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def namespace_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("""SELECT doc_id, CASE WHEN lang <> 'en' THEN 'page' WHEN doc_id % 3 = 0 THEN 'redirect' WHEN contains(text, 'English') THEN 'entry' ELSE 'dropped' END AS kind FROM documents""")
def page_router(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", dump.ENTRY).otherwise(dump.TEMPLATE).alias("ns"), F.when(F.col("doc_id") % 3 == 0, "x").alias("redirect"), F.col("text").alias("escaped"))
    return dump.routed(rows).select("doc_id", "kind")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'tion') GROUP BY lang")
def substring_prefilter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT title, kind, md5(text) AS digest FROM (
    SELECT 'Doc & ' || doc_id AS title, 'page' AS kind, text FROM documents WHERE lang <> 'en'
    UNION ALL SELECT 'Doc & ' || doc_id, 'redirect', '' FROM documents WHERE lang = 'en' AND doc_id % 3 = 0
    UNION ALL SELECT 'Doc & ' || doc_id, 'entry', text || ' English' FROM documents WHERE lang = 'en' AND doc_id % 3 <> 0)""")
def xml_dump_scan(spark, sf_dir):
    """Documents written as a bzip2-compressed dump, scanned, filtered by namespace and decoded."""
    d = table(spark, sf_dir, "documents").orderBy("doc_id")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ns = F.when(F.col("lang") == "en", "0").otherwise("10")
    redirect = F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), '    <redirect title="x" />\n').otherwise("")
    body = F.when(redirect != "", "").when(F.col("lang") == "en", F.concat("text", F.lit(" English"))).otherwise(F.col("text"))
    page = F.concat(F.lit("  <page>\n    <title>Doc &amp; "), F.col("doc_id").cast("string"), F.lit("</title>\n    <ns>"), ns, F.lit("</ns>\n"), redirect, F.lit('    <text xml:space="preserve">'), esc(body), F.lit("</text>\n  </page>"))
    path = _scratch(spark, "dump")
    d.select(page.alias("value")).write.option("compression", "bzip2").text(path)
    rows = dump.decoded(dump.routed(dump.kept(dump.pages(spark, path))).where("kind <> 'dropped'"), "title", "escaped")
    return rows.select("title", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


def _scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder where the cluster shares files, removed when the driver ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/lexspark-{tag}-{uuid.uuid4().hex}"
    files = store.Hadoop(spark)
    at, fs = files._at(path)
    fs.deleteOnExit(at)
    return path


# -- text functions ----------------------------------------------------------------------------

_XML = "replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, md5({_XML}) AS digest FROM pages")
def xml_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_text(F.col("html")).cast("binary")).alias("digest"))


@query(f"SELECT page_id, md5({_XML}) AS digest FROM pages")
def xml_unescape_native(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.named_entities(F.col("html")).cast("binary")).alias("digest"))


@query(r"SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g')) AS digest FROM pages")
def comment_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_comments(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 - o_custkey % 3 AS BIGINT) AS balance FROM orders")
def brace_balance(spark, sf_dir):
    c = F.concat(F.repeat(F.lit("{{"), (F.col("o_orderkey") % 4).cast("int")), F.lit("x"), F.repeat(F.lit("}}"), (F.col("o_custkey") % 3).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.brace_balance(c).alias("balance"))


@query(r"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br([^A-Za-z0-9>][^>]*)?>', ' ', 'g'), '</*[A-Za-z0-9][^>]*>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '\[http[^\] ]*( ([^\]]*))?\]', '\2', 'g'), '''{5}|''{3}|''{2}', '', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, trim(regexp_replace(t, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM c)
    SELECT page_id, md5(trim(replace(replace(replace(replace(t, ' ,', ','), '( ', '('), ' )', ')'), '()', ''))) AS digest FROM d""")
def html_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_plain(F.col("html")).cast("binary")).alias("digest"))


@query("""SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""")
def link_extract(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return reports.counted(links, "href")


@query("SELECT page_id, 'see ' || page_id || ' and  end' AS shown FROM pages")
def external_link_strip(spark, sf_dir):
    c = F.concat(F.lit("see ["), "url", F.lit(" "), F.col("page_id").cast("string"), F.lit("] and ["), "url", F.lit("] end"))
    return table(spark, sf_dir, "pages").select("page_id", T.external_links(c).alias("shown"))


@query("""
    WITH h AS (SELECT p_partkey, p_name, p_partkey % 4 AS a, p_size % 4 AS b FROM part)
    SELECT p_partkey, CASE WHEN least(a, b) > 0 THEN CAST(least(a, b) AS INT) END AS level,
        CASE WHEN least(a, b) > 0 THEN trim(repeat('=', CAST(a - least(a, b) AS INT)) || ' ' || p_name || ' ' || repeat('=', CAST(b - least(a, b) AS INT))) END AS name FROM h""")
def heading_parse(spark, sf_dir):
    line = F.concat(F.repeat(F.lit("="), (F.col("p_partkey") % 4).cast("int")), F.lit(" "), "p_name", F.lit(" "), F.repeat(F.lit("="), F.col("p_size") % 4))
    line = F.regexp_replace(line, r"^ ", "x ")  # no heading without a leading mark
    return table(spark, sf_dir, "part").select("p_partkey", T.heading(line).alias("h")).select("p_partkey", "h.level", "h.name")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 4 AS k, l_returnflag || ' ' || l_linestatus AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN k < 2 THEN l_linenumber END AS depth, CASE WHEN k < 2 THEN t END AS text FROM l""")
def meaning_lines(spark, sf_dir):
    k = F.col("l_quantity").cast("int") % 4
    mark = F.when(k == 0, " ").when(k == 1, "\t ").when(k == 2, ":").otherwise("* ")
    line = F.concat(F.repeat(F.lit("#"), F.col("l_linenumber")), mark, "l_returnflag", F.lit(" "), "l_linestatus", F.lit("\u2003"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.meaning_line(line).alias("m")).select("l_orderkey", "l_linenumber", "m.depth", "m.text")


@query("""
    SELECT n_name AS title, CAST(b AS INT) AS block_idx, w AS word_type, CAST(i AS INT) AS meaning_idx, CAST(d AS SMALLINT) AS depth, replace(t, 'NAME', n_name) AS text FROM nation,
    (VALUES (0, 'Noun', 0, 1, 'a {{x |y}} NAME'), (0, 'Noun', 1, 2, 'sub NAME'), (0, 'Noun', 2, 1, 'again'), (1, 'Verb', 0, 1, 'to NAME')) v(b, w, i, d, t)""")
def section_extract(spark, sf_dir):
    text = "==French==\n# no\n==English==\n# orphan\n===Noun===\n# a {{x\n|y}} NAME\n#: ex\n## sub NAME<!-- c\n-->\n===NOUN===\n# again\n===Weird===\n# no\n===verb===\n#* q\n# to NAME\n==German==\n# no"
    pages = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.replace(F.lit(text), F.lit("NAME"), F.col("n_name")).alias("text"))
    return store.flat(sections.english_sections(pages))


@query("""
    WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, user_id, event_type, CAST(sum(CASE WHEN event_type <> before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS block_idx FROM s""")
def block_islands(spark, sf_dir):
    return sections.islands(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT source AS heading, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, heading LIMIT 15")
def skipped_heading_top(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.concat(F.lit("==English==\n==="), "source", F.lit("===\n# one\n# two\n")).alias("text"))
    odd = sections.english_sections(pages).select("title", F.explode("skipped").alias("heading")).withColumn("kind", F.lit("heading"))
    return reports.skipped_headings(odd, 15)


@query("""SELECT count(*) AS pages, count(*) FILTER (lang = 'en') AS main_pages, CAST(sum(n_chars) AS BIGINT) AS chars, (SELECT count(*) FROM labels WHERE quality = 1) AS good FROM documents""")
def extract_totals(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").agg(F.count("*").alias("pages"), F.count_if(F.col("lang") == "en").alias("main_pages"), F.sum("n_chars").alias("chars"))
    return totals.crossJoin(table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("good")))


# -- rendering: counts -------------------------------------------------------------------------


def _templates(*pages: tuple[str, str]) -> list[tuple[str, None, str]]:
    return [(f"Template:{t}" if ":" not in t else t, None, text) for t, text in pages]


@query("""SELECT count(*) AS lines, count(*) FILTER (doc_id % 5 = 0) AS empty, count(*) FILTER (doc_id % 5 = 1) AS leftover, count(*) FILTER (doc_id % 5 = 2) AS depth_exceeded FROM documents""")
def quality_stats(spark, sf_dir):
    known = Library.of_pages(_templates(("loop", "{{loop}}")))
    mark = F.element_at(F.array(*map(F.lit, ("{{rfdef|en}}", "left [[ open", "deep{{loop}}", "word", "'''b'''"))), (F.col("doc_id") % 5 + 1).cast("int"))
    meaning = F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), mark.alias("text")))
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.array(F.struct(F.lit("Noun").alias("word_type"), meaning.alias("meanings"))).alias("blocks"))
    return render.quality(render.render(entries, known))


@query("""SELECT kind, "key", n, sample, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, "key") AS rank FROM (
        SELECT 'missing' AS kind, 'Template:' || o_orderpriority AS "key", count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS sample FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'fallback', 'mod' || o_orderstatus || '|f', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 'maintenance', 'rfv', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders)) WHERE rank <= 4""")
def render_events_top(spark, sf_dir):
    text = F.concat(F.lit("{{"), "o_orderpriority", F.lit("|a}} {{#invoke:mod"), "o_orderstatus", F.lit("|f|x}} {{rfv}}"))
    meaning = F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), text.alias("text")))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("title"), F.array(F.struct(F.lit("Noun").alias("word_type"), meaning.alias("meanings"))).alias("blocks"))
    return reports.top_per_kind(render.events(render.render(entries, Library())), limit=4)


@query("""SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS "key", n, sample, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS rank FROM (SELECT event_type, user_id, count(*) AS n, min(event_id) AS sample FROM events GROUP BY ALL)) WHERE rank <= 5""")
def topk_per_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("title"))
    return reports.top_per_kind(rows, limit=5)


@query("""
    WITH w AS (SELECT o_orderpriority AS name FROM orders UNION ALL SELECT 'st ' || o_orderstatus FROM orders UNION ALL SELECT '' FROM orders UNION ALL SELECT 'q' FROM orders),
    c AS (SELECT name, count(*) AS n FROM w GROUP BY name)
    SELECT CAST(row_number() OVER o AS INT) AS rank, name, n, CAST(sum(n) OVER o AS BIGINT) AS running, 100.0 * CAST(sum(n) OVER o AS DOUBLE) / (SELECT sum(n) FROM c) AS share
    FROM c WINDOW o AS (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING)""")
def template_freq(spark, sf_dir):
    text = F.concat(F.lit("{{ "), "o_orderpriority", F.lit(" |x}} and {{st "), "o_orderstatus", F.lit("}} {{{{q}}}}"))
    return reports.template_frequency(table(spark, sf_dir, "orders").select(text.alias("text")))


# -- look-up -----------------------------------------------------------------------------------


def _nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    titles = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("title"))
    target = F.concat(F.lit("NATION_"), (F.col("n_nationkey") - 1).cast("string"))
    return n, titles, n.where("n_nationkey % 4 < 2").select(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 1, target).otherwise("nowhere").alias("target"))


@query("""SELECT c_custkey, n_name AS form, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 4 = 1 THEN 'NATION_' || (n_nationkey - 1) END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def entry_or_redirect(spark, sf_dir):
    n, titles, redirects = _nations(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("form"))
    return asked.join(lookup.known_forms(titles, redirects), "form", "left").select("c_custkey", "form", "title")


_FORMS = """
    WITH t AS (SELECT r_name AS n, false AS s FROM region UNION ALL SELECT r_name, true FROM region UNION ALL SELECT lower(r_name) || '’s.', true FROM region UNION ALL SELECT n_name || '.', true FROM nation),
    b AS (SELECT n, s, lower(n[1]) || n[2:] AS lf, regexp_matches(n, '^[A-Z]') AS up FROM t),
    l AS (SELECT n, s, CASE WHEN NOT up THEN [n] WHEN s THEN [lf, n, lower(n)] ELSE [n, lf, lower(n)] END AS f FROM b),
    e AS (SELECT n, s, unnest(f) AS f, generate_subscripts(f, 1) AS i FROM l),
    g AS (SELECT n, s, i * 2 AS o, replace(f, '’', '''') AS form FROM e UNION ALL SELECT n, s, i * 2 + 1, rtrim(replace(f, '’', ''''), '.') FROM e),
    m AS (SELECT n, s, form, min(o) AS o FROM g GROUP BY n, s, form)
    SELECT n AS token, s AS sentence_start, CAST(row_number() OVER (PARTITION BY n, s ORDER BY o) - 1 AS INT) AS rank, form FROM m"""


@query(_FORMS)
def candidate_forms(spark, sf_dir):
    r, n = table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation")
    rows = r.select(F.col("r_name").alias("token"), F.explode(F.array(F.lit(False), F.lit(True))).alias("sentence_start"))
    rows = rows.union(r.select(F.concat(F.lower("r_name"), F.lit("’s.")), F.lit(True))).union(n.select(F.concat("n_name", F.lit(".")), F.lit(True)))
    return rows.select("token", "sentence_start", F.posexplode(lookup.forms(F.col("token"), F.col("sentence_start"))).alias("rank", "form"))


@query("""SELECT n_nationkey AS id, CAST(k AS INT) AS tok, CASE WHEN n_nationkey % 2 = 0 THEN 'alpha beta gamma' ELSE 'beta gamma' END AS title FROM nation, (VALUES (0), (1), (2)) v(k) WHERE n_nationkey % 2 = 0 OR k > 0""")
def phrase_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "Alpha beta gamma omega").otherwise("Beta beta gamma omega").alias("text"))
    lines = n.select("id", tokens.word_array(F.col("text")).alias("words"))
    known = spark.createDataFrame([("alpha beta gamma", "alpha beta gamma"), ("beta gamma", "beta gamma"), ("omega", "omega")], "form string, title string")
    single = lines.select(F.explode("words").alias("t")).select("t.word", "t.sentence_start")
    return lookup.phrases(lines, ["id"], known, lookup.whole(single, known)).select("id", "tok", "title")


@query("""SELECT lower(r_name) || '-x' || n_nationkey || 'q''s' AS word, CAST(k AS INT) AS place, CASE WHEN k = 1 THEN 'missing' ELSE 'entry' END AS kind,
    CASE k WHEN 0 THEN lower(r_name) WHEN 1 THEN 'x' || n_nationkey || 'q' ELSE '''s' END AS target FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1), (2)) v(k)""")
def resolve_parts(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lower("r_name"), F.lit("-x"), F.col("n_nationkey").cast("string"), F.lit("q's")).alias("word"), F.lit(False).alias("sentence_start"))
    known = r.select(F.lower("r_name").alias("form"), F.lower("r_name").alias("title")).union(spark.createDataFrame([("'s", "'s")], "form string, title string"))
    found = lookup.parts(rows.distinct(), known, closure.checkpointed)
    w = Window.partitionBy("word").orderBy("path")
    return found.select("word", (F.row_number().over(w) - 1).alias("place"), "kind", "target")


@query("""
    WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS r FROM part),
    w AS (SELECT k AS start, 0 AS hop, k AS title, r FROM p UNION ALL SELECT w.start, w.hop + 1, p.k, p.r FROM w JOIN p ON w.r = p.k WHERE w.hop < 4)
    SELECT CAST(start AS VARCHAR) AS start, CAST(hop AS INT) AS hop, CAST(title AS VARCHAR) AS title, CAST(r AS VARCHAR) AS redirect FROM w""")
def redirect_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pages = p.select(F.col("p_partkey").cast("string").alias("title"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("string")).alias("redirect"), F.col("p_name").alias("text"))
    return reports.redirect_walk(pages, pages.select("title")).select("start", "hop", "title", "redirect")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey )")
def title_exists(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def title_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT p_name FROM part WHERE starts_with(p_name, 'red')")
def prefix_search(spark, sf_dir):
    return reports.prefix_search(table(spark, sf_dir, "part"), "red", "p_name")


@query("""SELECT title, count(*) OVER () AS matches FROM (SELECT 'Template:' || p_partkey AS title FROM part WHERE contains(p_name, 'bolt')) QUALIFY row_number() OVER (ORDER BY title) <= 30""")
def substring_search(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("Template:"), F.col("p_partkey").cast("string")).alias("title"), F.col("p_name").alias("text"))
    return reports.substring_search(pages, "bolt")


@query("""SELECT w AS word, CASE WHEN r_name IS NOT NULL THEN 'entry' WHEN n_name IS NOT NULL THEN 'redirect' ELSE 'none' END AS status, CASE WHEN r_name IS NULL AND n_name IS NOT NULL THEN 'R' || n_regionkey END AS target
    FROM (VALUES ('ASIA'), ('NATION_3'), ('nothing'), ('AFRICA')) v(w) LEFT JOIN region ON r_name = w LEFT JOIN nation ON n_name = w""")
def point_lookup(spark, sf_dir):
    entries = table(spark, sf_dir, "region").select(F.col("r_name").alias("title"), F.array(F.lit(1)).alias("blocks"))
    redirects = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("target"))
    asked = spark.createDataFrame([("ASIA",), ("NATION_3",), ("nothing",), ("AFRICA",)], "word string")
    return reports.show(store.Dictionary(entries, redirects, None, None, {}), asked).select("word", "status", "target")


@query("SELECT md5(text) AS title, max(doc_id) AS last_id, arg_max(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("title"), F.col("doc_id").alias("page_seq"), F.col("doc_id").alias("last_id"), "source")
    return store.last_wins(rows, "last_id", "source")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_wins_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id", "lang")
    return rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("r")).select("r.*")


# -- rendering ---------------------------------------------------------------------------------

_LABELS = 'labels["AFRICA"] = {aliases = {"AFR"}, display = "African"}\nlabels["or"] = {omit_preComma = true, omit_postComma = true}\nlabels["ASIA"] = "AFRICA"\nlabels["bad"] = f(x)\n'
_TAGS = 'tags["plural"] = {"number", "x", {"p", "pl"}}\ntags["first-person"] = {"person", "x", "1"}\nshortcuts["1p"] = {"1", "p"}\nshortcuts["12"] = "1//p"\n'
_PLACES = 'export.placetype_aliases = {\n\t["co"] = "county", c = "country",\n\t["obl"] = "oblast", ["cc"] = "constituent country",\n}\n'


def _library() -> Library:
    pages = {
        "lb": "{{#invoke:labels/templates|show}}", "q": "{{#invoke:qualifier/templates|qualifier_t}}", "l": "{{#invoke:links/templates|l_term_t}}", "form of": "{{#invoke:form of/templates|form_of_t|withcap={{{wc|}}}}}",
        "plural of": "{{#invoke:form of/templates|tagged_form_of_t|p}}", "infl of": "{{#invoke:form of/templates|inflection_of_t}}", "surname": "{{#invoke:names|surname}}", "given name": "{{#invoke:names|given_name}}", "place": "{{#invoke:place|show}}",
        "Module:labels/data": _LABELS, "Module:form of/data/1": _TAGS, "Module:place/placetypes": _PLACES, "Module:languages/data/2": 'm["fr"] = {"French", 1}\nm["de"] = {"German"}\n',
        "find": "{{#invoke:string/templates|find|{{{1}}}|{{{2}}}|{{{3|}}}|plain=1}}", "replace": "{{#invoke:string/templates|replace|{{{1}}}|{{{2}}}|{{{3}}}}}", "len": "{{#invoke:string/templates|len|{{{1}}}}}", "lang": "{{#invoke:languages/templates|getByCode|{{{1}}}|{{{2|}}}}}",
    }
    return Library.of_pages(_templates(*pages.items()), titles=["AFRICA", "ASIA"])


@query("""SELECT n_nationkey, '(' || CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN 'African' ELSE r_name END || ' or ' || n_name || ', rare) a ' || n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey""")
def label_list(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.when(F.col("r_name") == "AFRICA", "AFR").otherwise(F.col("r_name"))
    text = F.concat(F.lit("{{lb|en|"), label, F.lit("|or|"), "n_name", F.lit("|rare}} a [[x|"), "n_name", F.lit("]]"))
    return rendered_texts(rows, _library(), "n_name", text, "n_nationkey")


@query("""SELECT s_suppkey, 'first-person plural of ' || s_name || ' (“g”); first-person/plural and first-person of ' || s_name || ', plural of ' || s_name AS text FROM supplier""")
def tag_text(spark, sf_dir):
    text = F.concat(F.lit("{{infl of|en|"), "s_name", F.lit("#top||1p|t=g}}; {{infl of|en|"), "s_name", F.lit("||12|;|1}}, {{plural of|en|"), "s_name", F.lit("}}"))
    text = F.replace(text, F.lit("Supplier#"), F.lit("Supplier"))
    return rendered_texts(table(spark, sf_dir, "supplier"), _library(), "s_name", text, "s_suppkey").withColumn("text", F.replace("text", F.lit("Supplier"), F.lit("Supplier#")))


@query("""SELECT p_partkey, 'Form of ' || p_name || ' (“a”) and b (“c”), more. ' || p_brand_ || ' (“' || p_type || '”) (literally, “x”) (' || p_type || ', y)' AS text FROM (SELECT *, replace(p_brand, '#', ' ') AS p_brand_ FROM part)""")
def form_of(spark, sf_dir):
    brand = F.replace("p_brand", F.lit("#"), F.lit(" "))
    text = F.concat(F.lit("{{form of|en|wc=1|"), "p_name", F.lit("<t:a>,b<gloss:c>|addl=more|dot=.}} {{l|en|"), brand, F.lit("||"), "p_type", F.lit("|lit=x}} {{q|"), "p_type", F.lit("|y}}"))
    return rendered_texts(table(spark, sf_dir, "part"), _library(), "p_name", text, "p_partkey")


@query("""SELECT n_nationkey, 'An ' || n_name || ' surname from Old ' || r_name || ' or X, equivalent to ' || n_name || '. A male or female given name from ' || r_name || '. A county in Kyiv Oblast, ' || n_name || ', United Kingdom. Capital: ' || r_name AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def names_and_places(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("{{surname|en|"), "n_name", F.lit("|A=An|from=Old:"), "r_name", F.lit("|from2=X|eq="), "n_name", F.lit("}}. {{given name|en|male/female|from="), "r_name", F.lit("}}. {{place|en|co|obl/Kyiv|"), "n_name", F.lit("|c/UK|capital=city/"), "r_name", F.lit("}}"))
    return rendered_texts(rows, _library(), "n_name", text, "n_nationkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'is' ELSE 'not' END || ' ' || CASE WHEN o_orderkey % 3 = 1 THEN 'eq' ELSE 'ne' END || ' ' || CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '1' ELSE 'd' END
    || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'N' END || ' ' || lower(o_orderpriority) || ' Xy 2026 10 ' || CAST(o_orderkey AS VARCHAR) || ' {{{z}}} d | =' AS text FROM orders""")
def parser_functions(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("{{#if:"), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" "), F.lit("|is|not{{nope|{{rfd}}}}}} {{#ifeq:1.0|"), (k % 3).cast("string"), F.lit("|eq|ne}} {{#switch:"), "o_orderstatus", F.lit("|F|O=1|P=d|#default=z}} {{#ifexist:"),
        F.when(k % 2 == 0, "AFRICA").otherwise("MARS"), F.lit("|E|N}} {{lc:"), "o_orderpriority", F.lit("}} {{ucfirst:xy}} {{CURRENTYEAR}} {{LOCALMONTH}} {{PAGENAME}} {{{z}}} {{{y|d}}} {{!}} {{=}}{{#tag:ref|x}}{{fullurl:a}}{{NAMESPACE}}"),
    )
    return rendered_by_key(table(spark, sf_dir, "orders"), "o_orderkey", text, _library())


def rendered_by_key(rows: DataFrame, key: str, text: Column, known: Library) -> DataFrame:
    """key and rendered text of rows: each as an entry whose title is its key. Rows are dealt out before texts are made of them."""
    entries = render.dealt(rows, key).select(F.col(key).cast("string").alias("title"), _one_meaning(text).alias("blocks"))
    return render.render(entries, known, spread=False).select(F.col("title").cast("long").alias(key), F.col("blocks")[0]["meanings"][0]["text"].alias("text"))


def _invoking(**functions: str) -> list[tuple[str, None, str]]:
    return _templates(*((name, f"{{{{#invoke:{call}}}}}") for name, call in functions.items()))


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'A and B / dd / ' || p_name || ' / (' || p_name || ') / / ' || upper(p_name[1]) || p_name[2:] || '! / ' || p_partkey || ' / ' || p_name || ', b / H2O / ' || p_name || ' / y / x / ' || p_name
    || ' / A native or inhabitant of ' || p_name || ' (“g”) / Of, from or relating to ' || p_name || ' / Used other than figuratively or idiomatically: see ' || p_name || ' and b' AS text FROM part""")
def module_functions(spark, sf_dir):
    known = Library.of_pages(
        _invoking(
            sf="labels/templates/show_from|show_from|default=dd", df="links/templates|def_t|face={{{f|}}}", si="anchors/templates|senseid_t", cp="links/templates|cap_t", pn="pages/templates|pagename_t", ip="IPA/templates|IPAchar",
            ch="chemical formula|chem", ln="script utilities|lang_t", gl="glossary|link", tx="taxlink|taxlink", dn="demonym/templates|demonym_noun", da="demonym/templates|demonym_adj", al="definition/templates|and_lit_t",
        )
    )
    parts = ["{{sf|en|from=A,B}}", "{{sf|en}}", "{{df|@}}", "{{df|@|f=gloss}}", "{{si|en|x}}", "{{cp|@|!}}", "{{pn}}", "{{ip|@|b}}", "{{ch|H|2|O}}", "{{ln|en|@}}", "{{gl|x|y}}", "{{gl|x}}", "{{tx|a|b|@}}", "{{dn|en|@||g}}", "{{da|en|@}}", "{{al|en|@|b}}"]
    text = F.replace(F.lit(" / ".join(parts)), F.lit("@"), F.col("p_name"))
    return rendered_by_key(table(spark, sf_dir, "part"), "p_partkey", text, known)


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 't' || p_name || ' t' || p_name || ' [' || p_name || '] aBC AB ' || p_name || ' ' || p_name || ' ab ' || p_partkey || ' ' || p_partkey || ' end' AS text FROM part""")
def parser_words(spark, sf_dir):
    known = Library.of_pages([*_templates(("T a", "t{{{1}}}")), ("Appendix:X", None, "[{{{1}}}]")])
    text = F.replace(F.lit("{{subst:T a|@}} {{  T_a |@}} {{Appendix:X|@}} {{lcfirst:ABC}} {{uc:ab}} {{urlencode:@}} {{ns: @ }} {{safesubst:lc:AB}} {{FULLPAGENAME}} {{SUBPAGENAME}}{{#unknown:x|y}}{{localurl:x}}{{canonicalurl:y}} end"), F.lit("@"), F.col("p_name"))
    return rendered_by_key(table(spark, sf_dir, "part"), "p_partkey", text, known)


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'a' || p_name || ' [' || p_name || '] two ' || p_name || ' {{tr|x}} end' AS text FROM part""")
def transclusion(spark, sf_dir):
    pages = _templates(("tr", "a<noinclude>no</noinclude><includeonly>{{{1}}}</includeonly>"), ("oi", "x<onlyinclude>[{{{1}}}]</onlyinclude>y"), ("r3", "two {{{1}}}"))
    known = Library.of_pages([*pages, ("Template:r1", "Template:r2", ""), ("Template:r2", "Template:r3", "")])
    text = F.replace(F.lit("{{tr|@}} {{oi|@}} {{r1|@}} <nowiki>{{tr|x}}</nowiki> end"), F.lit("@"), F.col("p_name"))
    return rendered_by_key(table(spark, sf_dir, "part"), "p_partkey", text, known)


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name || ' label c d x2 y 5° A (' || p_name || ') bold, it “q” end' AS text FROM part""")
def plain_text(spark, sf_dir):
    parts = ["[[@]]", "[[a|label]]", "[[:c]]", "[[w:d]]", "[[Category:@]]<ref name=r>gone @</ref><ref name=s/>", "x<sup>2</sup>y", "5&deg;", "&#65;", "( @ )", "'''bold''' ,", "''it''", "&ldquo;q&rdquo;", "[http://x.y/z end]"]
    text = F.replace(F.lit(" ".join(parts)), F.lit("@"), F.col("p_name"))
    return rendered_by_key(table(spark, sf_dir, "part"), "p_partkey", text, Library())


@query("""SELECT CAST(doc_id AS VARCHAR) AS title, CAST(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS INT) AS word_types FROM documents WHERE doc_id % 3 > 0""")
def defined_entries(spark, sf_dir):
    """Entries without their empty meanings: every third has none left, every other loses a word type."""
    k = F.col("doc_id") % 3
    meaning = lambda text: F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), text.alias("text")))
    blocks = F.array(F.struct(F.lit("Noun").alias("word_type"), meaning(F.when(k > 0, "x").otherwise("")).alias("meanings")), F.struct(F.lit("Verb").alias("word_type"), meaning(F.when(k == 1, "y").otherwise("")).alias("meanings")))
    found = render.defined(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), blocks.alias("blocks")))
    return found.select("title", F.size("blocks").alias("word_types"))


@query("""SELECT c_custkey, c_mktsegment AS line FROM customer""")
def start_text(spark, sf_dir):
    """A start text of a title, credit, marker, blank lines and a line per customer, written and read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(":"), "c_mktsegment", F.lit("\r\n \n")).alias("line"))
    path = _scratch(spark, "start")
    rows.agg(F.concat(F.lit("Title\nCredit: x\n[definitions]\n\n"), F.array_join(F.array_sort(F.collect_list("line")), "")).alias("value")).coalesce(1).write.text(path)
    parts = F.split("line", ":")
    return dump.start_text(spark, path).select(parts[0].cast(rows.schema["c_custkey"].dataType).alias("c_custkey"), parts[1].alias("line"))


@query("""SELECT n_nationkey, 'The definitions below are taken from English Wiktionary' AS begins, 3 AS named FROM nation""")
def licence_credit(spark, sf_dir):
    make = F.udf(lambda n: document.credit_text(f"dump{n}", f"sha{n}", f"date{n}", "P"), "string", useArrow=True)
    n = F.col("n_nationkey").cast("string")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", make(n).alias("t"))
    named = sum(F.contains("t", F.concat(F.lit(x), n)).cast("int") for x in ("dump", "sha", "date"))
    return rows.select("n_nationkey", F.substring("t", 1, 55).alias("begins"), named.alias("named"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'i') THEN CAST(strpos(p_name, 'i') AS VARCHAR) ELSE '' END || '/' || replace(p_name, 'e', 'E') || '/' || length(p_name) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'French' WHEN 1 THEN 'German' ELSE '' END AS text FROM part""")
def string_fns(spark, sf_dir):
    code = F.element_at(F.array(F.lit("fr"), F.lit("de"), F.lit("xx")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("{{find|"), "p_name", F.lit("|i}}/{{replace|"), "p_name", F.lit("|e|E}}/{{len|"), "p_name", F.lit("}}/{{lang|"), code, F.lit("}}"))
    return rendered_texts(table(spark, sf_dir, "part"), _library(), "p_name", text, "p_partkey")


@query("""SELECT r_name, CAST(2 AS BIGINT) AS found, CAST(1 AS BIGINT) AS skipped, r_name || '"' AS first, 'x' || r_regionkey AS second, 'long ' || r_name AS third FROM region""")
def lua_literals(spark, sf_dir):
    source = F.concat(F.lit('-- t["no"] = 1\nt["'), "r_name", F.lit('\\""] = {display = "x'), F.col("r_regionkey").cast("string"), F.lit('", nil_value, f(1, "}"), 3}\nt["b"] = [[\nlong '), "r_name", F.lit(']]\nt["c"] = g("x") .. y\nu = {\n a = 1 }\n'))

    def parse(src: str) -> dict:
        found, skipped = assignments(src, "t")
        assert isinstance(assigned_table(src, "u"), Table)
        return {"found": len(found), "skipped": skipped, "first": found[0][0], "second": found[0][1].get("display"), "third": found[1][1]}

    read = F.udf(parse, "found long, skipped long, first string, second string, third string", useArrow=True)
    return table(spark, sf_dir, "region").select("r_name", read(source).alias("x")).select("r_name", "x.*")


@query("""WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey)
    SELECT r_name, CASE WHEN regexp_matches(r_name, '^[AEIOU]') THEN 'An' ELSE 'A' END AS article, array_to_string(l[1:-2], ', ') || ' or ' || l[-1] AS joined, lower(r_name[1]) || r_name[2:] AS lower_first, upper(lower(r_name)[1]) || lower(r_name)[2:] AS upper_first
    FROM region JOIN n ON r_regionkey = n_regionkey""")
def article_join_terms(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("l"))
    rows = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("r_name", T.article(F.concat(F.lit("['"), "r_name")).alias("article"), T.join_terms(F.col("l"), "or").alias("joined"), T.lower_first(F.col("r_name")).alias("lower_first"), T.upper_first(F.lower("r_name")).alias("upper_first"))


# -- document, closure, store ------------------------------------------------------------------


@query("""
    WITH l AS (SELECT l_orderkey, CASE WHEN pos % 3 = 1 THEN 1 WHEN pos % 3 = 2 THEN 2 ELSE 3 END AS depth, pos FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem))
    SELECT l_orderkey, CAST(pos AS INT) AS pos, CAST(CASE WHEN depth = 1 THEN (pos + 2) // 3 ELSE 1 END AS INT) AS number FROM l""")
def hierarchical_numbering(spark, sf_dir):
    depth = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: (i - 1) % 3 + 1)
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("rows"))
    return orders.select("l_orderkey", F.posexplode(document.numbered(depth)).alias("pos", "number")).select("l_orderkey", (F.col("pos") + 1).alias("pos"), "number")


def _graph(spark, sf_dir):
    """Word graph: each line's first word leads to its others."""
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(tokens.words(F.col("line")).alias("w")).where(F.size("w") > 1)
    return words.select(F.col("w")[0].alias("parent"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("target")).distinct()


@query(r"""
    WITH RECURSIVE w AS (SELECT list_transform(regexp_extract_all(lower(unnest(string_split(text, chr(10)))), '[\p{L}\p{N}][\p{L}\p{M}\p{N}''’.\-]*'), lambda x: regexp_replace(x, '[''’.\-]+$', '')) AS w FROM benchmark),
    e AS (SELECT DISTINCT w[1] AS parent, unnest(w[2:]) AS target FROM w WHERE len(w) > 1),
    c(word) AS (SELECT 'the' UNION SELECT target FROM c JOIN e ON word = parent) SELECT word FROM c""")
def closure_reach(spark, sf_dir):
    return closure.reached(closure.checkpointed(_graph(spark, sf_dir)), spark.createDataFrame([("the",)], "word string"))


@query("""
    SELECT ord, kind, word FROM (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS ord, kind, word FROM (
        SELECT 0 AS a, r_regionkey AS b, 'entry' AS kind, lower(r_name) AS word FROM region WHERE r_regionkey <> 3
        UNION ALL SELECT 0, 2.5, 'entry', 'note' UNION ALL SELECT 1, n_nationkey % 5 * 100 + n_nationkey, 'entry', 'n' || n_nationkey || 'x' FROM nation WHERE n_nationkey % 5 <> 3))""")
def closure_order(spark, sf_dir):
    """Start: the regions (one is left out); each leads to its nations, these to it again and to a common word."""
    r, n = table(spark, sf_dir, "region").where("r_regionkey <> 3"), table(spark, sf_dir, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("x"))
    block = lambda text: F.array(F.struct(F.lit("Note").alias("word_type"), F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), text.alias("text"))).alias("meanings")))
    members = n.groupBy((F.col("n_nationkey") % 5).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit("x"))), " ").alias("text"))
    entries = r.join(members, F.col("r_regionkey") == F.col("k")).select(F.lower("r_name").alias("title"), block(F.col("text")).alias("blocks"))
    own = n.withColumn("k", F.col("n_nationkey") % 5).join(r, F.col("k") == F.col("r_regionkey")).select(name.alias("title"), block(F.lower("r_name")).alias("blocks"))
    word = spark.range(1).select(F.lit("note").alias("title"), block(F.lit("note")).alias("blocks"))
    start = r.select(F.col("r_regionkey").cast("int").alias("line_no"), F.concat(F.initcap("r_name"), F.when(F.col("r_regionkey") == 2, " note").otherwise("")).alias("line"))
    none = spark.createDataFrame([], "title string, target string")
    return closure.close(spark, entries.union(own).union(word), none, start).order


@query("""WITH m AS (SELECT n_nationkey % 5 AS k, count(*) AS m FROM nation GROUP BY ALL)
    SELECT count(*) FILTER (k < 3) AS defined, count(*) AS entries, CAST(sum(m) FILTER (k < 3) AS BIGINT) AS meanings, 100.0 * count(*) FILTER (k < 3) / count(*) AS percent FROM m""")
def coverage_ratio(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 5).alias("k")).agg(F.array(F.struct(F.lit("Noun").alias("word_type"), F.collect_list("n_name").alias("meanings"))).alias("blocks"))
    rendered = n.select(F.col("k").cast("string").alias("title"), "blocks")
    order = n.where("k < 3").select(F.lit("entry").alias("kind"), F.col("k").cast("string").alias("word"))
    return reports.coverage(order, rendered)


@query("SELECT word, n FROM (SELECT event_type AS word, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, word LIMIT 3")
def missing_word_top(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return reports.missing_words(counts, 3)


@query("SELECT r_name AS title FROM region UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer")
def union_distinct_titles(spark, sf_dir):
    of = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("title"))
    return render.all_titles(store.Dictionary(of("region", "r_name"), of("nation", "n_name"), of("customer", "c_mktsegment"), None, {}))


@query("""SELECT 'D' || doc_id AS title, 'Noun' AS word_type, CAST(1 AS SMALLINT) AS depth, md5(text) AS digest, (SELECT count(*) FROM documents) AS entries, (SELECT count(*) FROM nation) AS redirects FROM documents""")
def dictionary_roundtrip(spark, sf_dir):
    meaning = F.array(F.struct(F.lit(1).cast("smallint").alias("depth"), F.col("text").alias("text")))
    entries = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"), F.array(F.struct(F.lit("Noun").alias("word_type"), meaning.alias("meanings"))).alias("blocks"))
    redirects = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.lit("x").alias("target"))
    pages = table(spark, sf_dir, "region").select(F.col("r_name").alias("title"), F.lit(None).cast("string").alias("redirect"), F.lit("t").alias("text"))
    path = _scratch(spark, "dictionary")
    store.write(spark, path, "0" * 40, entries, redirects, pages)
    d = store.read(spark, path, "0" * 40)
    return d.meanings().select("title", "word_type", "depth", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(d.meta["entries"]).cast("long").alias("entries"), F.lit(d.meta["redirects"]).cast("long").alias("redirects"))


@query("""
    WITH o AS (SELECT CAST(r_regionkey AS BIGINT) AS ord, r_name FROM region), n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
    c AS (SELECT n_regionkey, count(*) AS m FROM nation GROUP BY ALL)
    SELECT CAST(3 AS INT) AS part, ord, CAST(0 AS INT) AS line_no, '"' || r_name || '":' AS line FROM o
    UNION ALL SELECT 3, ord, 1, 'Noun' FROM o UNION ALL SELECT 3, ord, CAST(i + 1 AS INT), i || '. ' || n_name FROM o JOIN n ON ord = n_regionkey UNION ALL SELECT 3, ord, CAST(m + 2 AS INT), '' FROM o JOIN c ON ord = n_regionkey
    UNION ALL SELECT 3, 5, i, l FROM (VALUES (0, '"gone":'), (1, '(no entry in English Wiktionary)'), (2, '')) v(i, l)
    UNION ALL SELECT p, 0, i, l FROM (VALUES (0, 0, 'Name'), (0, 1, ''), (0, 2, 'Credit: x'), (0, 3, ''), (0, 4, 'CR'), (0, 5, ''), (1, 0, 'Definitions'), (2, 0, ''), (4, 0, 'end')) v(p, i, l)""")
def document_sink_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(F.lit(1).cast("smallint").alias("depth"), x["n_name"].alias("text"))).alias("m"))
    r = table(spark, sf_dir, "region")
    rendered = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("title"), F.array(F.struct(F.lit("Noun").alias("word_type"), F.col("m").alias("meanings"))).alias("blocks"))
    order = r.select(F.col("r_regionkey").cast("long").alias("ord"), F.lit("entry").alias("kind"), F.col("r_name").alias("word")).union(spark.createDataFrame([(5, "missing", "gone")], "ord long, kind string, word string"))
    return document.document(spark, ["Name", "", "Credit: x", "", "Definitions", "", "[definitions]", "end"], order, rendered, "CR")
