import ast
import json
import re

import pytest

from pagequery.functions import loose
from pagequery.operators import endpoints, fetching
from pagequery.plans import schema
from pagequery.plans.learn import extract_pages, learn_plan, plan_stats


def make_reader():
    def reader(told, view):
        body = json.loads(view)["body"]
        return "Sure: " + json.dumps({"items": [{"name": n, "price": p} for n, p in re.findall(r"<h2[^>]*>([^<]*)</h2><i>([^<]*)", body)]}) + " done"

    return reader


def page(names, tag="div"):
    return "<body>" + "".join(f"<{tag}><h2>{n}</h2><i>${i + 1}</i></{tag}>" for i, n in enumerate(names)) + "</body>"


def test_one_question_for_each_template(spark):
    pages = spark.createDataFrame([(1, "http://a/1", page("XY")), (2, "http://a/2", page("ZW")), (3, "http://a/3", page("Q", "p")), (4, "http://b/1", page("R")), (5, "http://b/2", None), (6, None, "")], "id long, url string, html string")
    rows, plans, asked = extract_pages(pages, {"name": "string", "price": "currency"}, make_reader(), required=["name"], view="slim_html")
    got = sorted((r.id, r.pos, r.name, r.price) for r in rows.where("_error IS NULL").collect())
    assert got == [(1, 0, "X", 1.0), (1, 1, "Y", 2.0), (2, 0, "Z", 1.0), (2, 1, "W", 2.0), (3, 0, "Q", 1.0), (4, 0, "R", 1.0)]
    assert sorted(r.id for r in rows.where("_error IS NOT NULL").collect()) == [5, 6]
    assert plans.count() == 3 and plan_stats(plans).first().domains == 2 and asked.where("error IS NULL").agg({"questions": "sum"}).first()[0] == 3

    def never(told, view):
        raise AssertionError

    again, kept, asked = extract_pages(pages.where("id <= 4"), {"name": "string", "price": "currency"}, never, plans, ["name"])
    assert again.where("_error IS NULL").count() == 6 and kept.count() == 3 and asked.count() == 0
    with pytest.raises(ValueError):
        extract_pages(pages, {"url": "string"}, make_reader())


def test_a_bad_answer_is_asked_again_with_its_fault():
    heard = []

    def slow(told, view):
        heard.append(told)
        return "nothing" if len(heard) == 1 else '{"items": [{"name": "X"}, {"name": ""}]}'

    plan, error, asked = learn_plan(page("X"), "{}", {"name": "string"}, slow, ["name"])
    assert plan["name"] and error is None and asked == 2 and "no items" in heard[1]
    assert learn_plan(page("X"), "{}", {"name": "string"}, lambda t, v: '{"items": [{"name": "not there"}]}') == (None, "no selector gives back: name", 2)


def test_fetching_escalates_and_uses_the_cache(spark):
    from pagequery.operators.fetching import Fetched

    def plain(url):
        if "slow" in url:
            raise TimeoutError("late")
        if "gone" in url:
            raise OSError("gone")
        return Fetched("x" * 20, 403) if "wall" in url else Fetched("<title>Just a moment</title>") if "bot" in url else Fetched("<p>" + "w" * 600)

    def second(url):
        return Fetched("<p>" + "v" * 600)

    cache = spark.sql("SELECT 'http://h/old' AS url, 'cached' AS html, 200 AS status, map('a', 'b') AS headers, 0 AS tier, timestamp'2020-01-01' AS fetched_at UNION ALL SELECT 'http://h/old', 'newer', 200, map(), 0, timestamp'2021-01-01'")
    urls = spark.createDataFrame([(f"http://h/{x}",) for x in ("ok", "ok", "slow", "gone", "wall", "bot", "old")] + [(None,)], "url string")
    got = {r.url[9:]: r for r in fetching.fetch(urls, {0: plain, 2: second}, cache, per_second=0).collect()}
    assert {k: v.tier for k, v in got.items()} == {"ok": 0, "slow": 2, "gone": 0, "wall": 2, "bot": 2, "old": 0}
    assert got["old"].html == "newer" and got["slow"].html.endswith("v") and got["slow"].error is None
    alone = {r.url[9:]: r for r in fetching.fetch(urls, {0: plain}, cache, ttl_seconds=10, per_second=0).collect()}
    assert alone["slow"].error == "TimeoutError: late" and alone["gone"].error == "OSError: gone" and alone["old"].html != "newer"


def test_loose_readers(spark):
    from pyspark.sql import functions as F

    texts = ['{"b": 1, "a": {"c": 2}}', 'so: {"a": 1} and {"b": 2}', '{"a": 1} tail', "[1]", "{bad", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", loose.loose_json(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j for r in rows] == ['{"a": {"c": 2}, "b": 1}', '{"a": 1}', '{"a": 1}', None, None, None, None]
    robots = "User-agent: x\nCrawl-delay: 9\nUser-Agent: * # all\nCrawl-delay: 2.5\nDisallow: /\ncrawl-delay: 3\nUser-agent: y\nCrawl-delay: 7"
    one = spark.createDataFrame([(robots, "```json\n{}\n```", " a b/c ")], "r string, f string, n string")
    got = one.select(loose.crawl_delay(F.col("r")).alias("r"), loose.without_fences(F.col("f")).alias("f"), loose.safe_name(F.col("n")).alias("n"), loose.crawl_delay(F.lit(None).cast("string")).alias("z")).first()
    assert tuple(got) == (3.0, "{}", "_a_b_c_", None)


def test_types_from_json_schema():
    made = schema.spark_type({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": ["null", "number"]}}, "c": {"anyOf": [{"type": "null"}, {"properties": {"d": {"type": "boolean"}}}]}, "e": {}}})
    assert made.simpleString() == "struct<a:bigint,b:array<double>,c:struct<d:boolean>,e:string>" and [f.nullable for f in made] == [False, True, True, True]
    with pytest.raises(ValueError):
        schema.spark_type([])


def test_discovery_and_client_code(spark):
    calls = spark.sql("""SELECT 1 AS id, 'get' AS method, 'http://h/a?Page=1' AS url, CAST(NULL AS STRING) AS request_body, map('X-Api-Key', 's3cret', 'a', 'b') AS request_headers, map('content-type', 'application/json') AS response_headers, '{"x": 1}' AS response_body
        UNION ALL SELECT 2, 'GET', 'http://h/a?Page=1', NULL, map(), map('content-type', 'application/json'), '{"y": "z"}' UNION ALL SELECT 3, 'post', 'http://h/b', '{"before": 1}', NULL, map('content-type', 'text/html'), '<p>'""")
    rows = endpoints.discover(calls, "id").collect()
    assert [(r.id, r.paging, r.auth, r.calls) for r in rows] == [(1, ["page"], ["x-api-key"], 2)] and "x" in rows[0].schema.lower() and "y" in rows[0].schema.lower()
    code = endpoints.client_code([r.asDict() for r in rows])
    assert ast.parse(code) and "s3cret" not in code


def test_queries_over_pages(spark):
    from pagequery.plans.ask import query_pages

    pages = spark.createDataFrame([(1, "http://a/1", page("XY")), (2, "http://b/1", page("Z"))], "id long, url string, html string")
    rows, _, _ = query_pages(pages, "{ name price(currency) }", make_reader(), view="slim_html")
    assert sorted((r.id, r.name, r._error) for r in rows.collect()) == [(1, "X", None), (1, "Y", "more than one record"), (2, "Z", None)]
    rows, _, _ = query_pages(pages, "{ all[] { name price(int) } }", make_reader(), view="slim_html")
    assert {r._error for r in rows.collect()} == {"price: missing"}  # a currency sign is no number
    for bad in ("{}", "{ a[] { b[] { c } } }", "{ a[] { b } c[] { d } }"):
        with pytest.raises(ValueError):
            query_pages(pages, bad, make_reader())


def test_following_ends_at_a_loop_a_gap_and_the_limit(spark):
    from pagequery.operators.paging import follow

    link = lambda to: f"<a class=next href='{to}'>more</a>"
    pages = spark.createDataFrame([("http://a/1", link("2")), ("http://a/2", link("1#x")), ("http://b/1", link("/gone")), ("http://c/1", None), ("http://c/1", "<p>"), (None, "x")], "url string, html string")
    seeds = spark.createDataFrame([("http://a/1#top",), ("http://b/1",), ("http://c/1",), ("http://none/",), (None,)], "url string")
    found = follow(seeds, pages, ["//a[@class='next']/@href"])
    assert sorted((r.root, r.page, r.url) for r in found.collect()) == [("http://a/1", 0, "http://a/1"), ("http://a/1", 1, "http://a/2"), ("http://b/1", 0, "http://b/1"), ("http://c/1", 0, "http://c/1")]
    assert follow(seeds, pages, ["//a/@href"], max_pages=1).count() == 3


def test_command_line(spark, tmp_path, capsys):
    from pagequery.__main__ import main

    assert main(["check", "{ a(int) }"]) == 0 and "bigint" in capsys.readouterr().out
    assert main(["check", "{ a("]) == 1 and main(["run", "nothing", "x", "y"]) == 1 and main(["queries"]) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.html").write_text("<h1>Top</h1><a href=/x>x</a>")
    assert main(["select", "h1", str(tmp_path / "in"), str(tmp_path / "o.jsonl")]) == 0
    assert json.loads((tmp_path / "o.jsonl").read_text())["value"] == ["Top"]
