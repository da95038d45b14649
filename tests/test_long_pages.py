import json
import re
import tracemalloc

from pyspark.sql import functions as F

from pagequery.functions.dom import Page
from pagequery.functions.pages import clean
from pagequery.operators.text import choose_payload
from pagequery.plans import extract, learn


def carried(frame):
    """The columns that each row of an explode brings along, by the plan."""
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    lists = re.findall(r"^Arguments: (?:pos)?explode\(.*\), \[([^\[\]]*)\], (?:true|false), \[[^\[\]]*\]$", plan, re.M)
    assert lists
    return plan, [c for found in lists for c in found.split(", ")]


def test_records_do_not_carry_all_matches_of_their_page(spark):
    pages = spark.createDataFrame([(1, {"a": ["x", "y"], "b": []}), (2, {"a": ["x"], "b": ["u", "v"]}), (3, {}), (4, {"a": [], "b": ["u"]}), (5, None)], "id int, found map<string,array<string>>")
    rows = extract.zip_fields(pages, ["a", "b"], ["a"])
    assert rows.columns == ["id", "_error", "pos", "a", "b"]
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, None, 0, "x", None), (1, None, 1, "y", None), (2, "unequal numbers of matches", 0, None, None), (3, "missing: a", 0, None, None), (4, "missing: a", 0, None, None), (5, "missing: a", 0, None, None)]
    assert [c.split("#")[0] for c in carried(rows)[1]] == ["id", "_error"]


def test_records_of_a_known_plan_do_not_carry_their_page(spark, monkeypatch):
    html = "<body>" + "".join(f"<h2>n{i}</h2>" for i in range(300)) + "</body>"
    pages = spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2", html.replace("h2", "h3"))], "id int, url string, html string")
    reader = lambda told, view: json.dumps({"items": [{"name": n} for n in re.findall(r"<h\d>([^<]*)</h", json.loads(view)["body"])]})
    _, plans, _ = learn.extract_pages(pages.where("id = 1"), {"name": "string"}, reader, required=["name"], view="slim_html")
    made, write = [], learn.written
    monkeypatch.setattr(learn, "written", lambda frame: made.append(frame) or write(frame))
    rows, _, asked = learn.extract_pages(pages, {"name": "string"}, reader, plans, required=["name"], view="slim_html")
    assert sorted(map(tuple, rows.where("_error IS NULL").groupBy("id").agg(F.count("name")).collect())) == [(1, 300), (2, 300)] and asked.count() == 1
    plan, names = carried(made[0])
    assert not any(c.startswith("found#") for c in names)
    for c in names:
        assert not c.startswith("html#") or re.search(rf"CASE WHEN .* THEN html#\d+ END AS {c}\b", plan)  # of pages that are read again, no others


def cards(n):
    return "<html><body>" + "".join(f'<article class="card" data-key="{i}"><a href="/p/{i}"><h2 class="name">n{i}</h2></a><span class="price">${i}</span></article>' for i in range(n)) + "</body></html>"


def test_a_tree_is_small(spark):
    html = cards(2000)
    tracemalloc.start()
    page = Page(html)
    held = tracemalloc.get_traced_memory()[0]
    bare = Page(html, bare=True)
    more = tracemalloc.get_traced_memory()[0] - held
    tracemalloc.stop()
    assert held < 450 * len(page.nodes) and more < 330 * len(page.nodes)  # 623 bytes an element, before
    assert bare.skeleton() == page.skeleton()
    for odd in ("", "x<html class=a><body class=b>t", "<p class=a>1<p class=a>2<br class=a>", "<?xml v?><a>", "<html class=a><p class=a>"):
        assert Page(odd, bare=True).skeleton() == Page(odd).skeleton()
    assert [n.attrs for n in Page("<html class=a><p class=a><html id=b>").nodes] == [{"class": "a", "id": "b"}, {}, {"class": "a"}]  # what the page adds later stays with its element


def test_a_view_of_a_long_page_needs_no_more_of_it(spark):
    texts = [cards(100), f"<p>{' ' * 3000}x</p>", f"<p>a{' ' * 900}</p>b", "", None]
    pages = spark.createDataFrame(list(enumerate(texts)), "id int, html string")
    view = lambda most: choose_payload(clean(F.col("html"), True, most), "slim_html", max_body=1000)
    assert pages.where(~view(1000).eqNullSafe(view(None))).count() == 0
    assert pages.select(F.length(clean(F.col("html"), True, 1000)["html_excerpt"]).alias("n")).where("n > 5000").count() == 0


def test_pages_of_one_file_are_read_by_several_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<h2>n{i}</h2>") for i in range(12)], "id int, url string, html string").coalesce(1)
    reader = lambda told, view: json.dumps({"items": [{"name": n} for n in re.findall(r"<h2>([^<]*)</h2>", json.loads(view)["body"])]})
    rows, _, asked = learn.extract_pages(pages, {"name": "string"}, reader, required=["name"], view="slim_html")
    got = rows.select("name", "_error", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.name for r in got) == sorted(f"n{i}" for i in range(12)) and not any(r._error for r in got) and asked.count() == 1
    assert len({r.task for r in got}) > 3
