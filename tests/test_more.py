"""Fetching over HTTP, paces, settings, recipes, schemas, models, state and the command line."""

import json
import threading
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequery import errors
from pagequery.__main__ import main
from pagequery.config import EngineConfig, configure_logging, configured, from_session
from pagequery.functions import loose
from pagequery.operators import crawl, fetching
from pagequery.plans import ask, learn, models, schema
from pagequery.sources import state, stores
from pagequery.streaming import watch


@pytest.fixture(scope="module")
def site():
    """A small site on this machine."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802 - the server's name
            status, body, kind = {"/": (200, '<h1>Grün</h1><a href="/next">n</a>'.encode("latin-1"), "text/html; charset=latin-1"), "/next": (200, b"<h1>next</h1>", "text/html")}.get(self.path, (404, b"none", "text/html"))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *told):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_over_http(spark, site):
    urls = spark.createDataFrame([(site + "/",), (site + "/gone",), ("ftp://x/",)], "url string")
    got = {r.url.removeprefix(site): r for r in fetching.fetch(urls, {0: fetching.HttpFetcher(timeout_seconds=5)}, per_second=0).collect()}
    assert "Grün" in got["/"].html and got["/"].status == 200 and got["/gone"].status == 404 and got["ftp://x/"].error.startswith("FetchError")
    found, failed = [], []
    pages = crawl.crawl_pages(urls.limit(1), {0: fetching.HttpFetcher()}, per_second=0, on_page=lambda df, depth: found.append((depth, df.count())), on_error=lambda df, depth: failed.append(df.count()))
    assert {(r.url.removeprefix(site), r.depth) for r in pages.collect()} == {("/", 0), ("/next", 1)} and found == [(0, 1), (1, 1)] and failed == [0, 0]
    seen = spark.createDataFrame([(site + "/next#x",)], "url string")
    assert crawl.crawl_pages(urls.limit(1), {0: fetching.HttpFetcher()}, per_second=0, seen=seen).count() == 1
    with pytest.raises(ValueError, match="either"):
        crawl.crawl_records(urls, {}, schema="a string", request="b")


def test_paces():
    clock = [0.0]
    made = lambda *a, **k: fetching.Pace(*a, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s), **k)
    own = made(2.0, 0.0, 1, 1)
    assert [own.wait("a"), own.wait("b"), own.wait("a"), own.wait("a")] == [0.0, 0.0, 0.5, 0.5]  # two a second of a host
    clock[0] = 0.0
    whole = made(0.0, 2.0, 1, 1)
    assert [whole.wait(h) for h in "abc"] == [0.0, 0.5, 0.5]  # two a second of all
    clock[0] = 0.0
    asked = made(0.0, 0.0, 1, 1)
    assert [asked.wait("a", 1.0), asked.wait("a", 1.0)] == [0.0, 1.0]  # a second between, as the host asks
    clock[0] = 0.0
    shared = made(2.0, 0.0, 4, 8, jitter=0.5)
    shared.wait("a")
    assert 2.0 <= shared.wait("a") <= 3.0  # a quarter of the rate, and up to half more


def test_a_hosts_urls_share_its_rate(spark):
    urls = spark.range(6).select(F.concat(F.lit("http://a.example/"), F.col("id").cast("string")).alias("url"))
    delays = spark.createDataFrame([("A.example", 0.2)], "host string, delay double")
    import time

    began = time.monotonic()
    assert fetching.fetch(urls, {0: lambda url: fetching.Fetched("x" * 600)}, per_second=0, delays=delays, tasks=2).where("error IS NULL").count() == 6
    assert time.monotonic() - began >= 1.0


def test_settings(spark):
    assert configured({"per_second": "3.5", "honor_robots": "no", "other": 1}) == EngineConfig(per_second=3.5, honor_robots=False, extra={"other": "1"})
    for bad, strict in (({"crawl_max_pages": "x"}, False), ({"other": "1"}, True), ({"per_second": -1.0}, False)):
        with pytest.raises(errors.ConfigError):
            configured(bad, strict=strict)
    spark.conf.set("spark.pagequery.crawl_max_depth", "7")
    assert from_session(spark).crawl_max_depth == 7
    spark.conf.unset("spark.pagequery.crawl_max_depth")
    assert len(configure_logging(EngineConfig()).handlers) == len(configure_logging(EngineConfig(log_level="info")).handlers) == 1
    with pytest.raises(errors.ConfigError):
        configure_logging(EngineConfig(log_level="loud"))


def test_errors_tell_their_facts():
    e = errors.ModelAuthError("refused", model="a/b")
    assert isinstance(e, errors.EngineError) and str(e) == "refused (model='a/b')" and issubclass(errors.FetchTimeout, TimeoutError)


def test_recipes_of_a_folder(tmp_path):
    (tmp_path / "good.json").write_text('{"url_pattern": "/a/", "query": "{ title }", "description": "d"}')
    (tmp_path / "bad.json").write_text('{"url_pattern": "(", "query": "{ title }"}')
    (tmp_path / "worse.json").write_text("no json")
    (tmp_path / "_draft.json").write_text("{}")
    book = stores.RecipeBook.load(str(tmp_path))
    assert list(book.recipes) == ["good"] and sorted(book.rejected) == ["bad", "worse"] and book.show("good").description == "d"
    with pytest.raises(KeyError, match="there are: good"):
        book.show("none")


@dataclass
class Offer:
    name: str
    price: float | None = None
    tags: list[str] = field(default_factory=list)


def test_schemas_of_every_form(tmp_path):
    want = ({"name": "string", "price": "float", "tags": "list"}, ["name"])
    (tmp_path / "held.py").write_text("Offer = {'type': 'object', 'properties': {'name': {'type': 'string'}, 'price': {'type': ['null', 'number']}, 'tags': {'type': 'array'}}, 'required': ['name']}")
    ddl = "name string not null, price double, tags array<string>"
    for form in (Offer, StructType.fromDDL(ddl), ddl, "{ name price(float, optional) tags(list, optional) }", f"{tmp_path}/held.py:Offer", "{ items[] { name price(float, optional) tags(list, optional) } }"):
        assert schema.fields_of(form) == want, form
    nested = {"type": "array", "items": {"properties": {"a": {"type": "object", "properties": {"b": {"anyOf": [{"type": "null"}, {"type": "integer"}]}}, "required": ["b"]}}, "required": ["a"]}}
    assert schema.fields_of(nested) == ({"a__b": "int"}, ["a__b"])
    for bad in (3, {}, "{ a { ", "no.such.module:Name"):
        with pytest.raises((ValueError, ImportError)):
            schema.fields_of(bad)


def test_models_by_name_and_checked_answers(spark):
    assert models.parse_model("Local/a/b:7") == ("local", "a/b:7")
    for bad in ("", "none", "/x", "x/"):
        with pytest.raises(errors.ConfigError):
            models.parse_model(bad)
    models.register_provider("Echo", lambda model: lambda told, view: f'{{"m": "{model}"}}')
    assert json.loads(models.client_for("echo/one")("", "")) == {"m": "one"}
    with pytest.raises(errors.ConfigError):
        models.client_for("absent/x")
    answers = iter(["no", "still no", '{"a": 1}'])
    assert models.constrained(lambda told, view: next(answers), lambda d: "a" in d)("q", "") == {"a": 1}
    for client in (lambda told, view: "never", lambda told, view: '{"b": 1}'):
        with pytest.raises(errors.ModelError):
            models.constrained(client, lambda d: "a" in d)("q", "")
    meter = models.Meter(spark)
    counted = meter.client(lambda told, view: "ok", "m")
    spark.range(5).mapInPandas(lambda parts: (p.assign(id=[len(counted("x", "y")) for _ in p["id"]]) for p in parts), "id long").collect()
    assert {r.measure: r.value for r in meter.report().collect()}["calls"] == 5


def test_a_schema_is_asked_for_once():
    calls = []

    def client(told, view):
        calls.append(told)
        return 'sure: {"json_schema": {"properties": {"a": {}}}}'

    assert ask.synthesize("view", "names, please", client) == ask.synthesize("view", "names, please", client) == {"properties": {"a": {}}} and len(calls) == 1
    with pytest.raises(errors.SchemaError):
        ask.synthesize("view", "else", lambda told, view: "I can't")


def test_answers_in_their_plainest_shape(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    assert ask.answer(df.limit(1), ["x"]) == "a" and ask.answer(df, ["x"]) == ["a", "b"] and ask.answer(df.limit(1), ["x", "y"]) == [{"x": "a", "y": 1}]


def test_healing_that_fails_is_told(spark):
    pages = spark.createDataFrame([("http://a.example/1", "<h1>x</h1>")], "url string, html string")
    good = lambda told, view: '{"items": [{"title": "x"}]}'
    empty = spark.createDataFrame([], learn.PLANS)
    rows, plans, failing = learn.heal(pages, empty, {"title": "string"}, good, ["title"])
    assert rows.first().title == "x" and plans.count() == 1 and failing.isEmpty()
    _, plans, failing = learn.heal(pages, empty, {"title": "string"}, good, ["title"], check=lambda part: False)
    assert plans.isEmpty() and failing.count() == 1
    with pytest.raises(errors.ExtractionError):
        learn.heal(pages, empty, {"title": "string"}, good, ["title"], check=lambda part: 1 / 0, strict=True)


def test_queries_with_lists_beside_lists(spark):
    pages = spark.createDataFrame([("http://a.example/1", "<h1>t</h1><ul><li class='p'>a</li><li class='p'>b</li></ul><p class='r'>good</p>")], "url string, html string")

    def client(told, view):
        body = json.loads(view)["body"]
        import re

        if "who" in told:
            return json.dumps({"items": [{"who": x} for x in re.findall(r'class="p">(\w+)', body)]})
        if "said" in told:
            return json.dumps({"items": [{"said": x} for x in re.findall(r'class="r">(\w+)', body)]})
        return json.dumps({"items": [{"head": {"title": "t"}}]})

    rows, _, asked = ask.query_roots(pages, "{ people[] { who } notes[] { said } head { title } }", client, view="slim_html")
    got = rows.first()
    assert [p.who for p in got.data.people] == ["a", "b"] and [n.said for n in got.data.notes] == ["good"] and got.data.head.title == "t" and got._error is None and asked.count() == 3
    with pytest.raises(ValueError, match="one list"):
        ask.query_pages(pages, "{ a[] { b[] { c } } }", client)
    with pytest.raises(ValueError, match="pagination"):
        ask.query_followed(pages, pages, "{ a[] { b } }", client)


def test_state_survives_a_failed_write(spark, tmp_path):
    table = state.StateTable(spark, f"file://{tmp_path}/s", "k int, v string", ["k"])
    table.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"))
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        table.write(table.read().select("k", F.raise_error(F.lit("no")).cast("string").alias("v")))
    assert sorted(table.read().collect()) == [(1, "b"), (2, "c")]
    table.delete(F.col("k") == 1)
    assert table.stats() == {"entries": 1}
    table.clear()
    assert table.stats() == {"entries": 0}
    held = state.CacheManager(spark, f"file://{tmp_path}/c")
    held.plans.upsert(spark.createDataFrame([("a.example", "t", {"x": ["h1"]}), ("b.example", "t", {"x": ["h2"]})], learn.PLANS))
    held.plans.clear("A.example")
    assert held.stats() == {"pages": 0, "plans": 1, "seen": 0}
    with pytest.raises(errors.StateError):
        state.CacheManager(spark, "")


def test_a_recording_without_its_page_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url": "http://a/", "status": 200}')
    (tmp_path / "b.json").write_text('{"url": "http://b/", "status": 200}')
    (tmp_path / "b.html").write_text("<p>b")
    with pytest.raises(Exception, match="no HTML file: a"):
        stores.read_replays(spark, str(tmp_path)).collect()


def test_small_tables_outside_spark(spark):
    df = spark.range(2)
    assert len(stores.to_frame(df, "pandas")) == stores.to_frame(df, "arrow").num_rows == 2 and stores.to_frame(df, "none") is None and stores.to_frame(df) is not None
    with pytest.raises(errors.OutputError):
        stores.to_frame(df, "other")


def test_a_callbacks_error_does_not_end_the_watch(spark, tmp_path):
    spark.createDataFrame([("u", 1, '{"a": "x"}')], "url string, version long, record string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, version long, record string").parquet(f"{tmp_path}/in")
    seen = []
    watch.on_change(watch.watch(stream), lambda batch, number: 1 / 0, f"{tmp_path}/check", on_error=lambda number, e: seen.append(type(e)), once=True).awaitTermination()
    assert ZeroDivisionError in seen


def test_names_and_fences(spark):
    row = spark.range(1).select(loose.safe_name(F.lit("")).alias("a"), loose.safe_name(F.lit("é x/" + "y" * 200)).alias("b"), loose.type_name("P", F.lit("--")).alias("c"), loose.without_fences(F.lit("plain")).alias("d")).first()
    assert row.a == "session" and row.b == ("é_x_" + "y" * 200)[:120] and row.c == "P_Model" and row.d == "plain"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.html").write_text("<h1>A</h1><h1>B</h1>")
    (tmp_path / "plan.json").write_text('{"name": "h1"}')
    assert main(["extract", str(tmp_path / "plan.json"), "{ x[] { name } }", str(tmp_path / "in"), str(tmp_path / "out.jsonl")]) == 0
    assert [json.loads(x)["name"] for x in (tmp_path / "out.jsonl").read_text().splitlines()] == ["A", "B"]
    for n, rows in (("old", [(1, "a"), (2, "b")]), ("new", [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, "k int, v string").write.parquet(str(tmp_path / n))
    assert main(["diff", str(tmp_path / "old"), str(tmp_path / "new"), "k", str(tmp_path / "diff.csv")]) == 0
    assert len((tmp_path / "diff.csv").read_text().splitlines()) == 4
    capsys.readouterr()
    assert main(["schema", "{ a(int) b(optional) }"]) == 0 and capsys.readouterr().out == "a: int (required)\nb: string\n"
    assert main(["config", "per_second=9"]) == 0 and json.loads(capsys.readouterr().out)["per_second"] == 9.0
    assert main(["config", "--strict", "none=9"]) == 1 and main(["schema", "{ a"]) == 1 and main(["recipes", str(tmp_path), "x"]) == 1
    assert main(["cache", f"file://{tmp_path}/state", "stats"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == {"pages": 0, "plans": 0, "seen": 0}
    assert main(["queries"]) == 0 and "nested_records" in capsys.readouterr().out


def test_a_crawls_caps_count_failures(spark):
    def tree_page(url: str) -> fetching.Fetched:
        """Page n of a tree leads to 2n and 2n + 1; every seventh fails."""
        n = int(url.rsplit("/", 1)[1])
        if n % 7 == 0:
            raise ConnectionError("no answer")
        return fetching.Fetched(f'<h1>{n}</h1><a href="/{2 * n}#x">a</a><a href="/{2 * n + 1}">b</a><a href="http://other.example/">c</a>' + " word" * 120)

    seeds = spark.createDataFrame([("http://t.example/1#top",)], "url string")
    told = lambda **caps: {(int(r.url.rsplit("/", 1)[1]), r.depth, r.error is not None) for r in crawl.crawl_pages(seeds, {0: tree_page}, max_depth=4, per_second=0, **caps).collect()}
    level, want = [1], []
    for depth in range(5):
        want += [(n, depth, n % 7 == 0) for n in level]
        level = [m for n in level if n % 7 for m in (2 * n, 2 * n + 1)]
    assert told(max_pages=20) == set(want[:20])
    assert told(max_pages=100, max_pending=3) <= set(want) and len(told(max_pages=100, max_pending=3)) == 1 + 2 + 3 + 3 + 3
