"""Command line: extract, show, wiki, render, render-text, templates, render-stats, build."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.markup.expand import Expander
from .operators import document, render, reports
from .plans.pipeline import build
from .session import build as session
from .sources import store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexspark", description=__doc__)
    p.add_argument("--dictionary", default="dictionary", help="folder of the dictionary's tables")
    p.add_argument("--sha1", help="digest that the dump must have")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("extract").add_argument("dump")
    for verb in ("show", "render"):
        verbs.add_parser(verb).add_argument("words", nargs="+")
    verbs.add_parser("wiki", help="TITLE, PREFIX* or ~TEXT").add_argument("titles", nargs="+")
    verbs.add_parser("render-text").add_argument("text")
    verbs.add_parser("templates")
    verbs.add_parser("render-stats")
    b = verbs.add_parser("build")
    b.add_argument("start")
    b.add_argument("out")
    b.add_argument("--dump-file", default="")
    b.add_argument("--dump-date", default="")
    b.add_argument("--project", default="This project")
    return p


def _wiki(spark, d: store.Dictionary, title: str) -> None:
    if title.startswith("~"):
        reports.substring_search(d.pages, title[1:]).show(30, truncate=False)
    elif title.endswith("*"):
        for row in reports.prefix_search(d.pages, title[:-1]).toLocalIterator():
            print(row["title"])
    else:
        rows = reports.redirect_walk(d.pages, spark.createDataFrame([(title,)], "title string")).orderBy("hop").collect()
        for r in rows:
            print(f"{r['title']} -> {r['redirect']}" if r["redirect"] else r["text"] if r["text"] is not None else f"{r['title']} is not in the dictionary")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = session()
    try:
        if a.verb == "extract":
            for k, v in store.extract(spark, a.dump, a.dictionary, a.sha1).items():
                print(f"{k:18} {v}")
            reports.skipped_headings(store.read(spark, a.dictionary).oddities).show(40, truncate=False)
            return 0
        d = store.read(spark, a.dictionary, a.sha1)
        if a.verb == "wiki":
            for title in a.titles:
                _wiki(spark, d, title)
        elif a.verb == "templates":
            reports.template_frequency(d.meanings()).orderBy("rank").show(40, truncate=False)
        elif a.verb == "render-text":
            print(Expander(render.library(d)).render("test", a.text)[0])
        elif a.verb in ("show", "render"):
            wanted = spark.createDataFrame([(w,) for w in a.words], "word string")
            entries = d if a.verb == "show" else store.Dictionary(render.render(d.entries.join(wanted.select(F.col("word").alias("title")), "title", "left_semi"), render.library(d)).select("title", "blocks"), d.redirects, d.pages, d.oddities, d.meta)
            for r in reports.show(entries, wanted).collect():
                print(f"{r['word']}: {r['status']}" + (f" -> {r['target']}" if r["target"] else ""))
                for block in r["blocks"] or []:
                    print(f"  {block['word_type']}", *(f"    {'#' * m['depth']} {m['text']}" for m in block["meanings"]), sep="\n")
        elif a.verb == "render-stats":
            done = render.checkpointed(render.render(d.entries, render.library(d)))
            render.quality(done).show()
            reports.top_per_kind(render.events(done)).orderBy("kind", "rank").show(120, truncate=False)
        elif a.verb == "build":
            made = build(spark, d, a.start, document.credit_text(a.dump_file, d.meta["sha1"], a.dump_date, a.project))
            document.write_document(made.lines, a.out)
            reports.coverage(made.closure.order, made.rendered).show()
            reports.missing_words(made.closure.missing).show(40, truncate=False)
            made.closure.missing.orderBy("first_ord").show(25, truncate=False)
    except (OSError, ValueError) as problem:
        print(problem, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
