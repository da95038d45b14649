import pytest

from pagequery.functions.dom import Page
from pagequery.functions.selectors import compile_css, values
from pagequery.plans import dsl, extract

HTML = """<html><head><title>T &amp; U</title></head><body><ul id=a><li class="x y">one<li>two <b>bold</ul>
<div class=card data-k=1><h2>A</h2><p>p1<p>p2</div><div class=card data-k=2><h2>B</h2></div><br>tail</body></html>"""


@pytest.mark.parametrize("selector, wanted", [
    ("li.x", ["one"]), ("ul > li", ["one", "two bold"]), ("div[data-k='2'] h2", ["B"]), ("li + li b", ["bold"]), ("h2, b", ["bold", "A", "B"]),
    ("div.card:nth-child(2) h2", ["A"]), ("p:last-child", ["p2"]), ("div:not([data-k='1']) h2", ["B"]), ("//div[@class='card'][2]/h2", ["B"]),
    ("//div/@data-k", ["1", "2"]), ("//li[last()]", ["two bold"]), ("//p[contains(text(),'2')]", ["p2"]), ("/html/head/title", ["T & U"]),
])
def test_selectors(selector, wanted):
    assert values(Page(HTML), selector) == wanted


@pytest.mark.parametrize("bad", ["", "div >", "::x", "a:hover(", "[x"])
def test_bad_selectors_raise(bad):
    with pytest.raises(ValueError):
        compile_css(bad)


def test_tree_is_region_encoded():
    page = Page(HTML)
    for n in page.nodes:
        inside = {d.pre for d in page.descendants(n)}
        assert all((page.nodes[i].parent in inside | {n.pre}) for i in inside)
    assert Page("<?xml version='1.0'?><a/>").nodes == [] and Page(None).nodes == []
    assert page.xpath(next(n for n in page.nodes if n.attrs.get("data-k") == "2")) == "/html/body/div[2]"


@pytest.mark.parametrize("bad", ["", "{", "{ a[] }", "{ a(int, float) }", "{ a(optional, optional) }", "{ a(min_count) }", "{ a(min_count=x) }", "{ a() }", "{ a(nope) }", "{ a } b"])
def test_bad_queries_raise(bad):
    with pytest.raises(ValueError):
        dsl.parse(bad)


def test_query_types():
    root = dsl.parse("{ items[] { name price(currency, optional) tags(list, min_count=1) } pagination { next_page_url(url) } }")
    assert dsl.spark_type(root) == "struct<`items`:array<struct<`name`:string,`price`:double,`tags`:array<string>>>,`pagination`:struct<`next_page_url`:string>>"
    assert dsl.has_pagination(root) and dsl.primary_list(dsl.parse("{ a[] { b } c(optional) }")).name == "a"
    assert dsl.spark_type(dsl.parse("{}")) == "struct<>"


def test_coercions_of_a_record(spark):
    raw = '{"fare":"€ 48,210.75","seats":"3,120","delay":null,"open":"Available","stops":"Kiel; Ulm","notes":"{\\"z\\": [2]}"}'
    rows = dsl.apply_query(spark.createDataFrame([(raw,)], "raw string"), "{ fare(currency) seats(int) delay(float, optional) open(bool) stops(list, min_count=4) notes(json) }", "raw")
    got = rows.first()
    assert (got.data.fare, got.data.seats, got.data.delay, got.data.open, got.data.stops, got.data.notes) == (48210.75, 3120, None, True, ["Kiel", "Ulm"], '{"z":[2]}')
    assert got._errors == ["stops: fewer than 4"]


def test_induced_selectors_give_the_examples_back():
    found = extract.induce_selectors(HTML, {"name": ["A", "B"], "first": ["one"]})
    assert found["name"] and all(values(Page(HTML), s) == ["A", "B"] for s in found["name"]) and "li.x" in found["first"]


def test_trees_of_any_depth_are_written_out():
    page = Page("<div>" * 5000 + "x")
    assert page.html(page.nodes[0]).count("</div>") == 5000 and page.skeleton().count("<div>") == 5000


def test_cleaning_and_the_choice_of_a_view(spark):
    from pyspark.sql import functions as F

    from pagequery.functions import pages as P
    from pagequery.operators import text

    cells = "".join(f"<tr><td>{1000 + i}</td><td>{i + 20}.50</td></tr>" for i in range(30))
    told = "<h1>Top</h1><h2>Part</h2><p>First.</p><ul><li>one</li><li>two</li></ul><nav>menu</nav><div class='cookie-note'>no</div>"
    rows = spark.createDataFrame([(1, f"<body>{told}</body>"), (2, f"<body><article>Numbers</article><div id=d>{'<table>' + cells}</table></div></body>"), (3, None), (4, "<body>" + "<p>$12.00</p>" * 4 + "<p>A name that is long enough to count</p>" * 2)], "id long, html string")
    got = {r.id: r for r in rows.select("id", P.clean(F.col("html")).alias("c")).select("id", "c", text.choose_payload(F.col("c")).alias("view"), text.choose_payload(F.col("c"), "markdown").alias("md")).collect()}
    assert got[1].c.markdown == "# Top\n\n## Part\n\nFirst.\n\n- one\n\n- two" and got[1].c["items"] == ["# Top", "## Part", "First.", "one", "two"]
    assert "menu" not in got[1].c.html_excerpt and "cookie" not in got[1].c.html_excerpt and got[1].view == got[1].c.flat_json
    assert '"format":"html_excerpt"' in got[2].view and "1029" in got[2].view
    assert got[3].c.markdown == "" and got[3].view == '{"heading": "", "items": []}'
    assert '"format":"html_excerpt"' in got[4].view and got[4].md.startswith('{"format":"markdown"')
    with pytest.raises(ValueError):
        text.choose_payload(F.col("c"), "pdf")


def test_shells_challenges_and_words_for_true(spark):
    from pyspark.sql import functions as F

    from pagequery.functions import coerce
    from pagequery.functions import pages as P

    shells = ["", None, "<div id='app'></div><script src=webpack.js>", "<div id='root'></div>", "<script>" * 25]
    frame = spark.createDataFrame(list(enumerate(shells)), "i int, h string")
    assert [r.s for r in frame.select("i", P.looks_like_shell(F.col("h")).alias("s")).orderBy("i").collect()] == [True, True, True, False, True]
    calls = spark.createDataFrame([("Just a moment...", None), ("x", {"CF-Ray": "1"}), ("x", {"Set-Cookie": "a=cf-ray"}), (None, {"a": "b"})], "t string, h map<string,string>")
    assert [r[0] for r in calls.select(P.looks_challenged(F.col("t"), F.col("h"))).collect()] == [True, True, True, False]
    words = spark.createDataFrame([("off",), ("none",), (" NO ",), ("",), (None,), ("Available",)], "w string")
    assert [r[0] for r in words.select(coerce.to_bool(F.col("w"))).collect()] == [True, True, False, False, None, True]


def test_dom_chunks_keep_records_apart(spark):
    from pagequery.operators import text

    html = "<body><div>intro <section>inner</section></div><div class=c>r1</div><div class=c>r2</div><main>end</main></body>"
    rows = text.dom_chunks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"), 200).orderBy("pos").collect()
    assert [(r.page_id, r.text) for r in rows] == [(1, "intro inner\ninner"), (1, "r1"), (1, "r2"), (1, "end")]


def test_selectors_are_tried_once_however_many_elements_suggest_them(monkeypatch):
    cards = "".join(f'<article class="card"><h2 class="name">n{i}</h2><span class="price">$5</span></article>' for i in range(200))
    tried = []
    monkeypatch.setattr(extract, "values", lambda page, s: tried.append(s) or values(page, s))
    found = extract.induce_selectors(f"<body><b>$5</b>{cards}</body>", {"name": [f"n{i}" for i in range(200)], "price": ["$5"] * 200})
    assert found == {"name": ["h2.name", "h2"], "price": ["span.price", "span"]} and len(tried) == len(set(tried)) <= 6
    assert extract.induce_selectors("<p>a</p><p>a</p>", {"x": ["a"]})["x"] == ["/html/body/p[1]", "/html/body/p[2]"]
