"""Command line: ``python -m pagequery COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields as fields_in
from pathlib import Path

from pagequery.errors import EngineError


def _session():
    from pyspark.sql import SparkSession

    from pagequery.session import ship

    spark = SparkSession.builder.appName("pagequery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _pages(spark, path: str):
    from pagequery.sources.stores import read_pages

    return spark.read.parquet(path) if path.endswith(".parquet") else read_pages(spark, path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagequery", description="Queries over tables of web pages.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the registered queries")
    check = commands.add_parser("check", help="whether a query of the record language parses")
    check.add_argument("query")
    run = commands.add_parser("run", help="runs a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("output", help="a file whose suffix names the format")
    read = commands.add_parser("read", help="reads pages (a Parquet table with url and html, or a folder of HTML files)")
    read.add_argument("what", choices=["links", "article", "markdown", "tables", "json_ld", "records", "metadata"])
    read.add_argument("pages")
    read.add_argument("output")
    select = commands.add_parser("select", help="values of a CSS selector or path")
    select.add_argument("selector")
    select.add_argument("pages")
    select.add_argument("output")
    chunks = commands.add_parser("chunk", help="chunks of a table of documents (doc_id, text)")
    chunks.add_argument("documents")
    chunks.add_argument("output")
    chunks.add_argument("--max-tokens", type=int, default=2000)
    plan = commands.add_parser("extract", help="reads records of pages by a plan, a JSON file of field to selectors")
    plan.add_argument("plan")
    plan.add_argument("schema", help="fields: DDL, a query of the record language, module:Name or file.py:Name")
    plan.add_argument("pages")
    plan.add_argument("output")
    diff = commands.add_parser("diff", help="field changes between two Parquet tables")
    diff.add_argument("old")
    diff.add_argument("new")
    diff.add_argument("key")
    diff.add_argument("output")
    recipes = commands.add_parser("recipes", help="recipes of a folder of JSON files, or one of them")
    recipes.add_argument("folder")
    recipes.add_argument("name", nargs="?")
    schema = commands.add_parser("schema", help="fields and required ones of a schema")
    schema.add_argument("schema")
    config = commands.add_parser("config", help="the settings that key=value pairs make")
    config.add_argument("pairs", nargs="*")
    config.add_argument("--strict", action="store_true", help="unknown settings are errors")
    cache = commands.add_parser("cache", help="state below a folder: entries, or clear them")
    cache.add_argument("folder")
    cache.add_argument("action", choices=["stats", "clear"])
    cache.add_argument("--domain", help="only the plans of this domain")
    given = parser.parse_args(argv)
    try:
        return _run(given)
    except (EngineError, ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(given: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from pagequery import catalog
    from pagequery.functions import pages as P
    from pagequery import catalog_more  # noqa: F401 - adds its queries
    from pagequery.config import configured
    from pagequery.functions.coerce import COERCIONS
    from pagequery.operators import text
    from pagequery.operators.changes import diff as diff_rows
    from pagequery.plans import dsl
    from pagequery.plans.extract import matched, zip_fields
    from pagequery.plans.schema import fields_of
    from pagequery.sources.state import CacheManager
    from pagequery.sources.stores import RecipeBook, write_output

    if given.command == "queries":
        print("\n".join(catalog.QUERIES))
        return 0
    if given.command == "check":
        try:
            print(dsl.spark_type(dsl.parse(given.query)))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if given.command == "schema":
        fields, required = fields_of(given.schema)
        print("\n".join(f"{n}: {kind}{' (required)' if n in required else ''}" for n, kind in fields.items()))
        return 0
    if given.command == "config":
        held = configured(dict(p.split("=", 1) for p in given.pairs), strict=given.strict)
        print(json.dumps({f.name: dict(held.extra) if f.name == "extra" else getattr(held, f.name) for f in fields_in(held)}, indent=2))
        return 0
    if given.command == "recipes":
        book = RecipeBook.load(given.folder)
        shown = [book.show(given.name)] if given.name else [book.recipes[n] for n in sorted(book.recipes)]
        print("\n".join(f"{r.name}\t{r.url_pattern}\t{r.query}\t{r.description}" for r in shown))
        for name, why in sorted(book.rejected.items()):
            print(f"left out {name}: {why}", file=sys.stderr)
        return 0
    if given.command == "run" and given.name not in catalog.QUERIES:
        print(f"no query of that name: {given.name}", file=sys.stderr)
        return 1
    spark = _session()
    if given.command == "run":
        out = catalog.QUERIES[given.name](spark, given.tables)
    elif given.command == "cache":
        held = CacheManager(spark, given.folder)
        if given.action == "clear":
            held.plans.clear(given.domain) if given.domain else held.clear()
        print(json.dumps(held.stats()))
        return 0
    elif given.command == "diff":
        old, new = spark.read.parquet(given.old), spark.read.parquet(given.new)
        out = diff_rows(old, new, given.key, [c for c in old.columns if c in new.columns and c != given.key])
    elif given.command == "extract":
        fields, required = fields_of(given.schema)
        plan = {k: [v] if isinstance(v, str) else list(v) for k, v in json.loads(Path(given.plan).read_text(encoding="utf-8")).items()}
        chosen = F.create_map(*[x for n in fields for x in (F.lit(n), F.array(*map(F.lit, plan.get(n, []))).cast("array<string>"))])
        rows = zip_fields(_pages(spark, given.pages).withColumn("found", matched(F.col("html"), chosen)).drop("html"), list(fields), required)
        out = rows.select("url", "pos", *[COERCIONS[k][1](F.col(n)).alias(n) for n, k in fields.items()], "_error")
    elif given.command == "chunk":
        out = text.token_chunks(spark.read.parquet(given.documents).select("doc_id", "text"), max_tokens=given.max_tokens)
    else:
        url, html = F.col("url"), F.col("html")
        made = {
            "links": lambda: P.links(url, html), "article": lambda: P.article(html), "markdown": lambda: P.markdown(html), "tables": lambda: P.tables(html),
            "json_ld": lambda: P.json_ld(html), "records": lambda: P.detect_records(url, html), "metadata": lambda: P.metadata(html),
        }
        value = P.select_values(html, given.selector) if given.command == "select" else made[given.what]()
        out = _pages(spark, given.pages).select("url", value.alias("value"))
    write_output(out, given.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
