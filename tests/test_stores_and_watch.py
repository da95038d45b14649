import csv
import gzip
import json
import sqlite3

import pytest

from pagequery.sources.stores import Recipe, RecipeBook, read_replays, safe_table, write_output
from pagequery.streaming.watch import compare, watch


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x|y", None), (2, "ü", [1, 2])], "b long, a string, c array<int>")
    for name in ("o.json", "o.jsonl.gz", "o.csv", "o.md", "o.sqlite", "o.duckdb", "o.parquet"):
        write_output(df, str(tmp_path / name))
    assert sorted(r["b"] for r in json.loads((tmp_path / "o.json").read_text())) == [1, 2]
    with gzip.open(tmp_path / "o.jsonl.gz", "rt") as f:
        assert len(f.readlines()) == 2
    with open(tmp_path / "o.csv") as f:
        assert next(csv.reader(f)) == ["a", "b", "c"]
    assert "x\\|y" in (tmp_path / "o.md").read_text()
    with sqlite3.connect(tmp_path / "o.sqlite") as db:
        assert sorted(db.execute("SELECT a, b FROM data")) == [('"x|y"', "1"), ('"ü"', "2")]
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    with pytest.raises(ValueError):
        safe_table("x; drop")


def test_replays(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"url": "http://a/", "status": 200}')
    (tmp_path / "p.html").write_text("<p>hi")
    row = read_replays(spark, str(tmp_path)).first()
    assert (row.url, row.status, row.html) == ("http://a/", 200, "<p>hi")


def test_recipes_that_do_not_parse_are_set_aside():
    book = RecipeBook([Recipe("good", "x", "{ a }"), Recipe("bad", "x", "{ a"), Recipe("worse", "(", "{ a }")])
    assert list(book.recipes) == ["good"] and set(book.rejected) == {"bad", "worse"}


def test_compare():
    assert compare("u", 1, None, {"a": "1"}) == [("u", 1, "a", None, "1", "added")]
    assert compare("u", 2, {"a": "1", "b": "x"}, {"a": "2"}) == [("u", 2, "a", "1", "2", "modified"), ("u", 2, "b", "x", None, "removed")]


def test_watch_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "url string, version long, record string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    write([("u", 1, '{"title": "v1"}')])
    changes = watch(spark.readStream.schema(schema).parquet(str(source)))
    query = changes.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        write([("u", 2, '{"title": "v2"}'), ("u", 1, '{"title": "old"}')])
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM seen").collect())
    assert got == [("u", 1, "title", None, "v1", "added"), ("u", 2, "title", "v1", "v2", "modified")]


def test_replays_are_listed_by_folder(spark, tmp_path):
    """The folder is the only path that is read, however many recordings it has, and recordings keep their fields."""
    from pyspark.sql import functions as F

    from pagequery.sources.stores import record_pages

    pages = spark.range(90).select(F.concat(F.lit("https://s/x?id="), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"), F.when(F.col("id") % 4 == 0, 404).otherwise(200).alias("status"))
    assert record_pages(pages, str(tmp_path)).count() == 90
    (tmp_path / "two.json").write_text('[{"url": "a", "status": 1},\n {"url": "b", "status": 2}]')
    (tmp_path / "two.html").write_text("<p>two")
    found = read_replays(spark, str(tmp_path))
    got = {r.url: (r.html, r.status) for r in found.select("url", "html", "status").collect()}
    assert got == {f"https://s/x?id={k}": (f"<p>{k}", 404 if k % 4 == 0 else 200) for k in range(90)} | {"a": ("<p>two", 1), "b": ("<p>two", 2)}
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan text" in x]
    assert len(scans) == 1 and "(1 paths)" in scans[0]
