"""Sinks by file suffix, replay bundles and the catalog of named queries."""

from __future__ import annotations

import gzip
import json
import re
import sqlite3
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pagequery.errors import OutputError
from pagequery.functions.loose import safe_name


def safe_table(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"bad table name: {name!r}")
    return name


def _rows(df: DataFrame) -> Iterator[dict]:
    """Rows as JSON objects, a partition at a time; for the single-file sinks, whose readers are small tools."""
    for line in df.toJSON(use_unicode=True).toLocalIterator():
        yield json.loads(line)


def _open(path: str, mode: str = "wt"):
    return gzip.open(path, mode, encoding="utf-8") if path.endswith(".gz") else open(path, mode, encoding="utf-8")


def write_output(df: DataFrame, path: str, table: str = "data") -> None:
    """Writes by suffix: .json (an array), .jsonl, .csv, .md, .sqlite or .db, .duckdb, a single file each, with .gz where text; .parquet is a Spark folder. Others as .json. Columns of .csv and .md are sorted by name."""
    kind = Path(path.removesuffix(".gz")).suffix.lower()
    names = sorted(df.columns)
    if kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == ".jsonl":
        with _open(path) as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in _rows(df))
    elif kind == ".csv":
        import csv

        with _open(path) as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(names)
            out.writerows([("" if r.get(n) is None else r[n] if isinstance(r[n], str) else json.dumps(r[n])) for n in names] for r in _rows(df))
    elif kind == ".md":
        cell = lambda v: ("" if v is None else v if isinstance(v, str) else json.dumps(v)).replace("|", "\\|").replace("\n", " ")
        with _open(path) as f:
            f.write("| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n")
            f.writelines("| " + " | ".join(cell(r.get(n)) for n in names) + " |\n" for r in _rows(df))
    elif kind in (".sqlite", ".db"):
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {safe_table(table)} ({', '.join(f'"{n}" TEXT' for n in names)})")
            db.executemany(f"INSERT INTO {table} ({', '.join(f'"{n}"' for n in names)}) VALUES ({', '.join('?' * len(names))})", ([json.dumps(r.get(n), ensure_ascii=False) for n in names] for r in _rows(df)))
    elif kind == ".duckdb":
        import duckdb

        from pagequery.operators.crawl import written

        held = written(df)  # as Parquet, which DuckDB reads piece by piece where it can reach it
        folder = Path(held.inputFiles()[0].replace("file://", "")).parent if held.inputFiles() else None
        with duckdb.connect(path) as db:
            if folder is not None and folder.is_dir():
                db.execute(f"CREATE OR REPLACE TABLE {safe_table(table)} AS SELECT * FROM read_parquet(?)", [f"{folder}/*.parquet"])
            else:
                db.register("found", held.toArrow())
                db.execute(f"CREATE OR REPLACE TABLE {safe_table(table)} AS SELECT * FROM found")
    else:
        with _open(path) as f:
            last = "["
            for r in _rows(df):  # a row at a time
                f.write(last + "\n  " + json.dumps(r, ensure_ascii=False, indent=2).replace("\n", "\n  "))
                last = ","
            f.write("[]" if last == "[" else "\n]")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """HTML files of a folder as pages: url (the file's), html."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_replays(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded fetches: JSON files with url, status and headers, joined with the HTML files of the same name. A recording without its HTML file raises when it is read."""
    from pagequery.operators.crawl import written

    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    # The folder is listed, not each file of it, and each file is opened once.
    text = lambda kind: spark.read.option("pathGlobFilter", f"*.{kind}").text(folder, wholetext=True).select(name.alias("name"), F.col("value").alias(kind))
    told = written(text("json"))
    lines = getattr(told.select("json")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = DataFrame(spark.read._jreader.json(lines), spark).schema
    meta = told.withColumn("one", F.explode_outer(F.from_json("json", ArrayType(schema))))
    meta = meta.select("name", *[(F.when(F.col("one").isNull(), F.col("json")) if c == "_corrupt_record" else F.col("one").getField(c)).alias(c) for c in schema.names])
    html = text("html")
    lacks = F.raise_error(F.concat(F.lit("a recorded fetch has no HTML file: "), F.col("name")))
    return meta.join(html, "name", "left").withColumn("html", F.coalesce("html", lacks.cast("string")))


def record_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each page (url, html, and status, headers, tier if there) as an HTML file and a JSON file of one name, as ``read_replays`` reads them: name, url.

    Names are of the URL and a hash, so a page that is recorded again is
    replaced. ``folder`` is a URI that executors can write, or a path they share.
    """
    about = [c for c in ("url", "status", "headers", "tier") if c in pages.columns]
    named = pages.select(F.concat(safe_name(F.regexp_replace("url", "^[a-z]+://", ""), 80), F.lit("-"), F.substring(F.sha2("url", 256), 1, 12)).alias("name"), "url", F.to_json(F.struct(*about)).alias("meta"), F.coalesce("html", F.lit("")).alias("html"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder else Path(folder).absolute().as_uri())
        store.create_dir(base, recursive=True)
        for part in parts:
            for name, meta, html in zip(part["name"], part["meta"], part["html"]):
                for kind, text in (("json", meta), ("html", html)):
                    with store.open_output_stream(f"{base}/{name}.{kind}") as out:
                        out.write(text.encode("utf-8", "replace"))
            yield part[["name", "url"]]

    from pagequery.operators.crawl import written

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(named.repartition(tasks, "name").mapInPandas(write, "name string, url string"))  # a file is the work of one task


def to_frame(df: DataFrame, engine: str = "auto"):
    """A small result outside Spark: a pandas or Arrow table, or None for ``none``. ``auto`` takes what the caller has imported already, pandas first."""
    if engine == "auto":
        engine = next((kind for kind, module in (("pandas", "pandas"), ("arrow", "pyarrow")) if module in sys.modules), "none")
    if engine not in ("pandas", "arrow", "none"):
        raise OutputError("unknown kind of table", engine=engine)
    return df.toPandas() if engine == "pandas" else df.toArrow() if engine == "arrow" else None


@dataclass(frozen=True)
class Recipe:
    """A named query for the pages that a pattern matches."""

    name: str
    url_pattern: str
    query: str
    description: str = ""


class RecipeBook:
    """Recipes that parse; others are reported in ``rejected``."""

    def __init__(self, recipes: list[Recipe]):
        from pagequery.plans.dsl import parse

        self.recipes: dict[str, Recipe] = {}
        self.rejected: dict[str, str] = {}
        for r in recipes:
            try:
                parse(r.query)
                re.compile(r.url_pattern)
                self.recipes[r.name] = r
            except (ValueError, re.error) as e:
                self.rejected[r.name] = str(e)

    @classmethod
    def load(cls, folder: str) -> RecipeBook:
        """The recipes of a folder's JSON files (name, url_pattern, query, description), in order of their names; files that begin with an underscore are left out, and those that can't be read are ``rejected``."""
        recipes, bad = [], {}
        for path in sorted(Path(folder).glob("*.json")):
            if path.name.startswith("_"):
                continue
            try:
                held = json.loads(path.read_text(encoding="utf-8"))
                recipes.append(Recipe(str(held.get("name") or path.stem), held["url_pattern"], held["query"], str(held.get("description", ""))))
            except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
                bad[path.stem] = f"{type(e).__name__}: {e}"
        book = cls(recipes)
        book.rejected |= bad
        return book

    def show(self, name: str) -> Recipe:
        if name not in self.recipes:
            raise KeyError(f"no recipe {name!r}; there are: {', '.join(sorted(self.recipes))}")
        return self.recipes[name]

    def match(self, pages: DataFrame) -> DataFrame:
        """Pages with the name of each recipe whose pattern they match."""
        named = F.array_compact(F.array(*[F.when(F.col("url").rlike(r.url_pattern), F.lit(r.name)) for r in sorted(self.recipes.values(), key=lambda r: r.name)]))
        return pages.withColumn("recipe", F.explode(named))


#: Our own recipes.
RECIPES = RecipeBook([
    Recipe("english_article", r"/en/\d+", "{ title body(optional) }", "an English article"),
    Recipe("tracked_link", r"[?&]utm_", "{ url(url) }", "a page reached through a tracked link"),
    Recipe("secure_page", r"^https://", "{ title }", "any page over TLS"),
])
