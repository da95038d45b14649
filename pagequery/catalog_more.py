"""More named queries: sinks read back, state, trees, chunks, healing, queries over pages in full, crawls and watches.

They join those of ``catalog`` when this module is imported.
"""

from __future__ import annotations

import json
import re
import uuid
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.catalog import _ALL_LINKS, _CARD_POS, _HOST, _calls, _cards, _query, _t
from pagequery.errors import ModelError
from pagequery.functions import coerce, loose, pages as P
from pagequery.operators import changes, crawl, endpoints, fetching, text
from pagequery.plans import ask, dsl, extract, learn, models
from pagequery.session import shared_folder
from pagequery.sources import state, stores
from pagequery.streaming import watch


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_path(spark: SparkSession, suffix: str) -> str:
    """A path for a single file that the driver writes and reads."""
    import tempfile

    return f"{tempfile.mkdtemp(prefix='pagequery-out-')}/rows{suffix}"


# Sinks, read back by other readers than the writer.

_SUNK = "SELECT c_custkey::BIGINT AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_name || ' | é' END AS name, c_mktsegment AS segment FROM customer"


def _to_sink(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit(" | é")))
    return _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), name.alias("name"), F.col("c_mktsegment").alias("segment"))


def _from_sink(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(int(r["k"]), r.get("name"), r["segment"]) for r in rows], "k long, name string, segment string")


@_query(_SUNK)
def sink_json(spark, sf):
    path = _own_path(spark, ".json.gz")
    stores.write_output(_to_sink(spark, sf), path)
    import gzip

    with gzip.open(path, "rt", encoding="utf-8") as f:
        return _from_sink(spark, json.load(f))


@_query(_SUNK)
def sink_jsonl(spark, sf):
    path = _own_path(spark, ".jsonl")
    stores.write_output(_to_sink(spark, sf), path)
    with open(path, encoding="utf-8") as f:
        return _from_sink(spark, map(json.loads, f))


@_query(_SUNK)
def sink_csv(spark, sf):
    path = _own_path(spark, ".csv")
    stores.write_output(_to_sink(spark, sf), path)
    import csv

    with open(path, encoding="utf-8", newline="") as f:
        return _from_sink(spark, [{**r, "name": r["name"] or None} for r in csv.DictReader(f)])


@_query(_SUNK)
def sink_markdown(spark, sf):
    path = _own_path(spark, ".md")
    stores.write_output(_to_sink(spark, sf), path)
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    cells = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]] for line in lines]
    return _from_sink(spark, [{**dict(zip(cells[0], row)), "name": row[1] or None} for row in cells[2:]])


@_query(_SUNK)
def sink_sqlite(spark, sf):
    """Written twice, as the sink appends; every cell is JSON."""
    import sqlite3

    path = _own_path(spark, ".sqlite")
    rows = _to_sink(spark, sf)
    stores.write_output(rows.where("k % 2 = 0"), path, "told")
    stores.write_output(rows.where("k % 2 = 1"), path, "told")
    with sqlite3.connect(path) as db:
        return _from_sink(spark, [dict(zip(("k", "name", "segment"), map(json.loads, r))) for r in db.execute("SELECT k, name, segment FROM told")])


@_query(_SUNK)
def sink_duckdb(spark, sf):
    import duckdb

    path = _own_path(spark, ".duckdb")
    stores.write_output(_to_sink(spark, sf), path)
    with duckdb.connect(path) as db:
        return _from_sink(spark, [dict(zip(("k", "name", "segment"), r)) for r in db.execute("SELECT k, name, segment FROM data").fetchall()])


@_query(_SUNK)
def sink_parquet(spark, sf):
    path = f"{_folder(spark, 'sink')}/rows.parquet"
    stores.write_output(_to_sink(spark, sf), path)
    return spark.read.parquet(path)


@_query("SELECT c_custkey::BIGINT AS k, c_name AS name, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey::VARCHAR FROM supplier")
def union_of_unlike(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"))
    b = _t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").cast("long").alias("k"))
    return changes.union_rows([a, b])


# Recordings and state.


def _supplier_pages(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://s.example/x?id="), F.col("s_suppkey").cast("string"))
    html = F.concat(F.lit("<h1>"), "s_name", F.lit("</h1>"))
    return _t(spark, sf, "supplier").select("s_suppkey", url.alias("url"), html.alias("html"), F.when(F.col("s_suppkey") % 4 == 0, 404).otherwise(200).alias("status"))


@_query("SELECT 'https://s.example/x?id=' || s_suppkey AS url, '<h1>' || s_name || '</h1>' AS html, CASE WHEN s_suppkey % 4 = 0 THEN 404 ELSE 200 END::BIGINT AS status FROM supplier")
def recorded_pages(spark, sf):
    """Pages recorded as files, twice, and replayed."""
    folder = _folder(spark, "replays")
    pages = _supplier_pages(spark, sf).drop("s_suppkey")
    stores.record_pages(pages, folder)
    stores.record_pages(pages.where("status = 404"), folder)
    return stores.read_replays(spark, folder).select("url", "html", "status")


@_query("SELECT 'http://h.example/' || k AS url, CASE WHEN k % 2 = 0 THEN 'first' ELSE 'second' END AS told FROM (SELECT DISTINCT p_partkey AS k FROM part)")
def seen_urls(spark, sf):
    """Even parts are met first; then all are, and only the odd ones are new. The set is read from its folder by another object."""
    url = F.concat(F.lit(" http://h.example/"), F.col("p_partkey").cast("string"))
    all_ = _t(spark, sf, "part").select("p_partkey", url.alias("url"))
    folder = _folder(spark, "seen")
    first = state.SeenUrls(spark, folder).add(all_.where("p_partkey % 2 = 0"))
    second = state.SeenUrls(spark, folder).add(all_.unionByName(all_))
    told = first.withColumn("told", F.lit("first")).unionByName(second.withColumn("told", F.lit("second")))
    return told.join(state.SeenUrls(spark, folder).read(), "url")


@_query("SELECT o_custkey, max(o_orderkey)::BIGINT AS at, arg_max(o_orderstatus, o_orderkey) AS html, count(DISTINCT o_orderstatus)::BIGINT AS versions FROM orders WHERE length(o_orderpriority) <= 8 GROUP BY 1")
def page_cache(spark, sf):
    """Orders as fetched pages of their customer, put in two parts: later ones replace the same markup, oversized and failed ones stay out."""
    o = _t(spark, sf, "orders")
    late = F.length("o_orderpriority") > 8
    pages = o.select(
        F.concat(F.lit("http://c.example/"), F.col("o_custkey").cast("string")).alias("url"), F.when(late & (F.col("o_orderkey") % 2 == 0), F.repeat(F.lit("x"), 100)).otherwise(F.col("o_orderstatus")).alias("html"),
        F.lit(200).alias("status"), F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("headers"), F.lit(0).alias("tier"), F.timestamp_seconds(F.col("o_orderkey")).alias("fetched_at"),
        F.when(late & (F.col("o_orderkey") % 2 == 1), "TimeoutError: slow").alias("error"), (F.col("o_orderkey") % 3 == 0).alias("part"),
    )
    cache = state.PageCache(spark, _folder(spark, "pages"), max_bytes=50)
    cache.put(pages.where("part"))
    cache.put(pages.where("NOT part").unionByName(pages.where("part")))
    versions = cache.read().groupBy("url").agg(F.count("*").alias("versions"))
    return cache.current().join(versions, "url").select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("o_custkey"), F.unix_seconds("fetched_at").alias("at"), "html", "versions")


@_query("SELECT 'd' || l_suppkey AS domain, 't' || l_partkey AS template, CASE WHEN l_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS selector FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey % 4 <> 0 AND l_partkey % 5 <> 0")
def plan_cache(spark, sf):
    """Plans by domain and template: a third are learned again, a fifth invalidated, and the first domain of four cleared."""
    keys = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    made = lambda rows, s: rows.select(F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("domain"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("template"), F.create_map(F.lit("f"), F.array(F.lit(s))).alias("plan"))
    cache = state.PlanCache(spark, _folder(spark, "plans"))
    cache.upsert(made(keys, "old"))
    cache.upsert(made(keys.where("l_partkey % 3 = 0"), "new"))
    cache.invalidate(made(keys.where("l_partkey % 5 = 0"), "any"))
    cache.delete(F.substr("domain", F.lit(2)).cast("long") % 4 == 0)
    return cache.read().select("domain", "template", F.col("plan")["f"][0].alias("selector"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 200 DAY")
def unexpired(spark, sf):
    return changes.unexpired(_t(spark, sf, "orders"), "o_orderdate", F.to_timestamp(F.lit("1998-01-01")), 200 * 86_400).select("o_orderkey")


# Trees.

_PATH = "'/html/body/div/article' || CASE WHEN n > 1 THEN '[' || rn || ']' ELSE '' END"
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@_query(f"""SELECT p_brand, p_partkey::VARCHAR AS key, {_PATH} AS xpath,
'<article class="card" data-key="' || p_partkey || '"><a href="/p/' || p_partkey || '"><h2 class="name">' || p_name || '</h2></a><span class="price">$' || p_size || '</span></article>' AS html, p_name || '$' || p_size AS text FROM {_RANKED}""")
def element_views(spark, sf):
    """Attributes, canonical path, outer markup and text of the elements that a selector finds."""
    found = _cards(spark, sf).select("p_brand", F.explode(P.elements(F.col("html"), "article.card")).alias("e"))
    return found.select("p_brand", F.col("e.attrs")["data-key"].alias("key"), "e.xpath", "e.html", "e.text")


@_query("SELECT p_brand, tag, sum(n)::BIGINT AS nodes, sum(c)::BIGINT AS children, sum(d)::BIGINT AS below, sum(s)::BIGINT AS siblings FROM (SELECT p_brand, unnest(['div', 'article', 'a', 'h2', 'span']) AS tag, unnest([1, k, k, k, k]) AS n, unnest([k, 2 * k, k, 0, 0]) AS c, unnest([5 * k - k, 3 * k, k, 0, 0]) AS d, unnest([0, k * (k - 1), k, 0, k]) AS s FROM (SELECT p_brand, count(*) AS k FROM part GROUP BY 1)) GROUP BY ALL")
def element_axes(spark, sf):
    """Children, descendants and siblings of every element, by joins over the numbered tree."""
    tree = _cards(spark, sf).select("p_brand", F.explode(P.nodes(F.col("html"))).alias("x")).select("p_brand", "x.pre", "x.size", "x.parent", "x.tag")
    family = tree.groupBy("p_brand", F.col("parent").alias("pre")).agg(F.count("*").alias("children"))
    own = tree.join(family, ["p_brand", "pre"], "left")
    beside = family.select("p_brand", F.col("pre").alias("parent"), (F.col("children") - 1).alias("siblings"))
    return own.join(beside, ["p_brand", "parent"]).where("tag IN ('div', 'article', 'a', 'h2', 'span')").groupBy("p_brand", "tag").agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("children"), F.lit(0)).cast("long").alias("children"), F.sum("size").cast("long").alias("below"), F.sum("siblings").cast("long").alias("siblings"))


@_query(f"SELECT p_brand, 'https://shop.example/' || p_brand AS url, {_PATH} AS xpath, 0 AS tier, rn % 2 = 0 AS from_plan, CASE WHEN rn % 2 = 1 THEN 'm/x' END AS model, epoch(TIMESTAMP '2024-05-01')::BIGINT AS at FROM {_RANKED}")
def record_provenance(spark, sf):
    found = _cards(spark, sf).select("p_brand", "url", F.posexplode(P.elements(F.col("html"), "article.card")).alias("pos", "e"))
    meta = P.provenance(F.col("url"), F.to_timestamp(F.lit("2024-05-01")), F.lit(0), F.col("e.xpath"), F.col("pos") % 2 == 1, F.lit("m/x"))
    return found.select("p_brand", meta.alias("m")).select("p_brand", "m.url", "m.xpath", F.col("m.fetch_tier").alias("tier"), "m.from_plan", "m.model", F.unix_seconds("m.fetched_at").alias("at"))


@_query("SELECT c_custkey, c_mktsegment || chr(10) || 'About ' || c_name || ' and more.' || chr(10) || 'The end.' AS text FROM customer")
def article_text(spark, sf):
    html = F.concat(F.lit("<html><body><header>site</header><nav><a href='/'>menu</a></nav><article><h1>"), "c_mktsegment", F.lit("</h1><p>About "), "c_name", F.lit(" and <b>more</b>.</p><script>x()</script><p>The end.</p></article><footer>legal</footer></body></html>"))
    return _t(spark, sf, "customer").select("c_custkey", P.article(html)["text"].alias("text"))


@_query("SELECT c_custkey, CASE WHEN n <= 40 THEN greatest(1, n // 4) END::VARCHAR AS tokens, CASE WHEN n <= 40 THEN c_mktsegment END AS heading FROM (SELECT *, length('{\"n\":\"' || repeat(c_name, (c_custkey % 3)::INT) || '\"}') AS n FROM customer)")
def hydrated_content(spark, sf):
    data = F.to_json(F.struct(F.expr("repeat(c_name, cast(c_custkey % 3 as int))").alias("n")))
    return _t(spark, sf, "customer").select("c_custkey", P.cleaned_state(data, F.col("c_mktsegment"), 40).alias("c")).select("c_custkey", F.col("c.tokens").cast("string").alias("tokens"), "c.heading")


@_query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS hash FROM pages")
def stripped_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(text.tag_stripped(F.col("html")), 256).alias("hash"))


@_query(f"SELECT domain, min(url) AS url, count(*) AS pages FROM (SELECT {_HOST} AS domain, url, array_to_string(regexp_extract_all(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'gs'), '<[a-zA-Z0-9]+'), '') AS t FROM pages) GROUP BY domain, t")
def template_sizes(spark, sf):
    return extract.representatives(extract.templates(_t(spark, sf, "pages"))).select("domain", "url", "pages")


@_query("SELECT p_brand, count(*)::BIGINT AS cards, min(p_partkey)::BIGINT AS first, list_sort(list(p_name))[1] AS name FROM part GROUP BY 1")
def xpath_scalars(spark, sf):
    """Functions and attributes by paths that the JVM evaluates."""
    found = _cards(spark, sf).select("p_brand", P.xpath_values(F.col("html"), "count(//article)")[0].alias("n"), P.xpath_values(F.col("html"), "//article[1]/@data-key")[0].alias("k"), P.xpath_values(F.col("html"), "//h2/text()").alias("names"))
    return found.select("p_brand", F.col("n").cast("double").cast("long").alias("cards"), F.col("k").cast("long").alias("first"), F.array_min("names").alias("name"))


@_query(f"SELECT p_brand, 'large ' || p_partkey AS key FROM {_RANKED} WHERE p_size > 10 AND (rn = n OR rn <= 2) UNION ALL SELECT p_brand, 'before ' || p_partkey FROM {_RANKED} WHERE rn = n - 1")
def xpath_axes(spark, sf):
    """Siblings, parents, comparisons and connected rules."""
    pages = _cards(spark, sf).withColumn("html", F.regexp_replace("html", r'"price">\$', '"price">'))
    large = P.select_values(F.col("html"), "//article[position() = last() or position() <= 2]/span[. > 10 and not(@id)]/../@data-key")
    before = P.select_values(F.col("html"), "//article[last()]/preceding-sibling::article[1]/@data-key")
    told = lambda found, word: pages.select("p_brand", F.explode(found).alias("k")).select("p_brand", F.concat(F.lit(word + " "), "k").alias("key"))
    return told(large, "large").unionByName(told(before, "before"))


# Strings.


@_query("SELECT c_custkey, '{\"n\": 1}' AS bare, left('a_b_' || replace(c_name, '#', '_') || '__', 16) AS file, 'T_a_b_' || replace(c_name, '#', '_') AS type, CASE WHEN c_custkey % 2 = 0 THEN 'http://x/' || c_custkey END AS url, CASE WHEN c_custkey % 2 = 0 THEN '{\"a\":1,\"b\":[2]}' END AS json FROM customer")
def small_strings(spark, sf):
    """Code fences, names of files and types, and the coercions of URLs and JSON."""
    even, name = F.col("c_custkey") % 2 == 0, F.concat(F.lit("a b/"), "c_name", F.lit("?!"))
    return _t(spark, sf, "customer").select(
        "c_custkey", loose.without_fences(F.lit(' ```JSON\n{"n": 1}\n``` ')).alias("bare"), loose.safe_name(name, 16).alias("file"), loose.type_name("T", F.concat(F.lit("?"), name)).alias("type"),
        coerce.to_url(F.when(even, F.concat(F.lit(" http://x/"), F.col("c_custkey").cast("string"))).otherwise("  ")).alias("url"), coerce.to_json(F.when(even, '{"b": [2], "a": 1}').otherwise("{bad")).alias("json"),
    )


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['authorization', 'x-api-key'] ELSE [] END::VARCHAR AS found FROM events")
def auth_headers(spark, sf):
    held = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("X-API-Key"), F.lit("a"), F.lit("Authorization"), F.lit("b"), F.lit("Accept"), F.lit("c"))).otherwise(F.create_map(F.lit("Accept"), F.lit("c")))
    names = endpoints.auth_headers(held)
    return _t(spark, sf, "events").select("event_id", F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("found"))


@_query("SELECT user_id, (rn - 1)::INT AS pos, CASE WHEN length(props) > 9 THEN length(props) END::INT AS cut, CASE WHEN length(props) <= 9 THEN props END AS body FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5")
def captured_events(spark, sf):
    """A user's events as the calls that a page recorded: five of a page, bodies of nine bytes."""
    call = F.struct("event_id", F.lit("GET").alias("method"), F.lit("http://x/").alias("url"), F.col("props").alias("response_body"))
    pages = _t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("network")).withColumn("url", F.col("user_id").cast("string"))
    return endpoints.captured_calls(pages.select(F.col("url"), "network"), 5, 9).select(F.col("page").cast("long").alias("user_id"), "pos", "cut", F.col("response_body").alias("body"))


# Chunks.


@_query("""
WITH RECURSIVE p AS (
  SELECT doc_id, trim(unnest(string_split(text, chr(10) || chr(10))), ' ' || chr(10) || chr(9) || chr(13)) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM documents
), k AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, length(part) AS len,
    CASE WHEN length(part) > 1024 THEN list_sum(list_transform(range(0, (length(part) + 1023) // 1024), lambda x: length(trim(substr(part, 1 + 1024 * x, 1024), ' ' || chr(10) || chr(9) || chr(13))))) ELSE 0 END AS cut,
    (length(part) + 1023) // 1024 AS pieces FROM p WHERE part <> ''
), s AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS held, 0::BIGINT AS chunks, 0::BIGINT AS chars FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL
  SELECT s.doc_id, k.i, CASE WHEN k.len > 1024 THEN 0 WHEN s.held > 0 AND s.held + k.len + 4 <= 1024 THEN s.held + k.len + 2 ELSE k.len END,
    s.chunks + CASE WHEN s.held > 0 AND (k.len > 1024 OR s.held + k.len + 4 > 1024) THEN 1 ELSE 0 END + CASE WHEN k.len > 1024 THEN k.pieces ELSE 0 END,
    s.chars + CASE WHEN s.held > 0 AND (k.len > 1024 OR s.held + k.len + 4 > 1024) THEN s.held ELSE 0 END + k.cut
  FROM s JOIN k ON k.doc_id = s.doc_id AND k.i = s.i + 1
)
SELECT doc_id, (chunks + (held > 0)::INT)::BIGINT AS chunks, (chars + held)::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS last FROM s) WHERE last = 1
""")
def token_chunk_sizes(spark, sf):
    """Documents packed by paragraphs: chunks and their characters, against the same greedy sum in SQL."""
    made = text.chunk(_t(spark, sf, "documents"), "token", max_tokens=256)
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@_query("SELECT doc_id, len(l)::BIGINT AS parts, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\n(#{1,6}\\s)', chr(10) || chr(10) || '\\1', 'g'), '\\n{2,}'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0")
def paragraph_parts(spark, sf):
    return text.paragraphs(_t(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("part")).alias("chars"))


@_query("SELECT n_regionkey::BIGINT AS region, (rn // 3)::BIGINT AS pos, string_agg(t, chr(10) ORDER BY n_nationkey) AS text, '/html/body/section[' || (min(rn) + 1) || ']' AS xpath FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS rn, rpad(n_name, 16, '.') AS t FROM nation) GROUP BY n_regionkey, rn // 3")
def packed_sections(spark, sf):
    """Sections of four tokens each, gathered to chunks of twelve or more."""
    section = F.concat(F.lit("<section>"), F.rpad("n_name", 16, "."), F.lit("</section>"))
    html = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", section.alias("s")))), lambda x: x["s"]), "").alias("x"))
    made = text.dom_chunks(html.select("n_regionkey", F.concat(F.lit("<html><body>"), "x", F.lit("</body></html>")).alias("html")), 12)
    return made.select(F.col("n_regionkey").cast("long").alias("region"), F.col("pos").cast("long").alias("pos"), "text", "xpath")


@_query(f"SELECT p_brand, (rn - 1)::BIGINT AS pos, p_name || '$' || p_size AS text, {_PATH} AS xpath FROM {_RANKED} WHERE n > 1")
def record_chunks(spark, sf):
    """Repeated records are chunks of their own; the grid around them is the chunk before."""
    made = text.dom_chunks(_cards(spark, sf).select("p_brand", "html"), 200).where(~F.col("xpath").endswith("/div"))
    return made.select("p_brand", (F.row_number().over(Window.partitionBy("p_brand").orderBy("pos")) - 1).cast("long").alias("pos"), "text", "xpath")


@_query("""
WITH RECURSIVE v AS (SELECT (vec_id // 20)::BIGINT AS doc, vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS i FROM embeddings),
m AS (
  SELECT doc, pos, i, [e] AS sums, 1::BIGINT AS grp FROM v WHERE i = 1
  UNION ALL
  SELECT doc, pos, i, CASE WHEN best >= 0.2 THEN list_transform(sums, lambda s, k: CASE WHEN k = best_at THEN list_transform(list_zip(s, e), lambda z: z[1] + z[2]) ELSE s END) ELSE list_append(sums, e) END, CASE WHEN best >= 0.2 THEN best_at ELSE len(sums) + 1 END
  FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims))::BIGINT AS best_at FROM (SELECT v.doc, v.pos, v.i, v.e, m.sums, list_transform(m.sums, lambda s: list_cosine_similarity(s, v.e)) AS sims FROM m JOIN v ON v.doc = m.doc AND v.i = m.i + 1))
)
SELECT doc, pos, (grp - 1)::INT AS grp FROM m
""")
def semantic_chunks(spark, sf):
    parts = _t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("long").alias("doc"), F.col("vec_id").alias("pos"), "embedding")
    return text.semantic_groups(parts, "doc", 0.2)


def _sentences(told: str) -> list[str]:
    return told.split(". ")


@_query("SELECT doc_id, len(list_filter(string_split(text, '. '), lambda x: trim(x) <> ''))::BIGINT AS chunks FROM documents WHERE len(list_filter(string_split(text, '. '), lambda x: trim(x) <> '')) > 0")
def sentence_chunks(spark, sf):
    """Chunks by a function of the caller's."""
    return text.custom_chunks(_t(spark, sf, "documents"), _sentences).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@_query("SELECT c_custkey, least(1024, 300 * (c_custkey % 9))::BIGINT AS floor, least(1500, 300 * (c_custkey % 9))::BIGINT AS cap FROM customer")
def payload_caps(spark, sf):
    """A view's length: never cut below 1024 characters by its own limit, always by the prompt's."""
    body = F.expr("repeat('x', cast(300 * (c_custkey % 9) as int))")
    cleaned = F.struct(F.lit("h").alias("heading"), body.alias("markdown"), F.array(body).alias("items"), F.lit("{}").alias("flat_json"), F.lit("").alias("html_excerpt"))
    size = lambda **caps: F.length(F.get_json_object(text.choose_payload(cleaned, "markdown", **caps), "$.body")).cast("long")
    return _t(spark, sf, "customer").select("c_custkey", size(max_markdown=10).alias("floor"), size(max_body=1500).alias("cap"))


@_query("SELECT c_custkey, c_custkey % 2 = 0 AS richer FROM customer")
def richer_markup(spark, sf):
    """Whether the markup has numbers that its text lost."""
    numbers = F.expr("array_join(transform(sequence(10, 30), x -> concat('<td class=\"cell number\">', cast(x * 100 + c_custkey % 7 as string), '</td>')), '')")
    text_ = F.when(F.col("c_custkey") % 2 == 0, "a few words only").otherwise(F.expr("array_join(transform(sequence(10, 30), x -> cast(x * 100 as string)), ' ')"))
    cleaned = F.struct(F.lit("").alias("heading"), text_.alias("markdown"), F.array(F.lit("")).alias("items"), F.lit("{}").alias("flat_json"), numbers.alias("html_excerpt"))
    return _t(spark, sf, "customer").select("c_custkey", text.markup_richer(cleaned).alias("richer"))


# Queries of the record language over pages.


def _card_reader(told: str, view: str) -> str:
    """Stands for a model: what a card's page says."""
    found = re.findall(r'<a href="([^"]*)"><h2 class="name">([^<]*)</h2></a><span class="price">([^<]*)</span>', json.loads(view)["body"])
    return json.dumps({"items": [{"name": unescape(n), "about": {"price": p, "size": p.strip("$")}} for _, n, p in found]})


@_query(f"SELECT p_brand, {_CARD_POS}, p_name AS name, p_size::DOUBLE AS price, p_size::BIGINT AS size FROM part")
def nested_records(spark, sf):
    """Objects inside the records of a page."""
    rows, _, _ = ask.query_pages(_cards(spark, sf), "{ products[] { name about { price(currency) size(int, optional) } } }", _sized_reader, view="slim_html")
    return rows.where("_error IS NULL").select("p_brand", F.col("pos").cast("long").alias("pos"), "name", F.col("about.price").alias("price"), F.coalesce("about.size", F.col("about.price").cast("long")).alias("size"))


def _sized_reader(told: str, view: str) -> str:
    answer = json.loads(_card_reader(told, view))
    return json.dumps({"items": [{"name": i["name"], "about": {"price": i["about"]["price"]}} for i in answer["items"]]})


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of a nation, ten on a page that leads to the next."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    placed = _t(spark, sf, "customer").withColumn("page", F.floor((F.row_number().over(w) - 1) / 10)).withColumn("last", F.max("page").over(Window.partitionBy("c_nationkey")))
    row = F.concat(F.lit('<li class="who">'), "c_name", F.lit("</li>"))
    at = lambda page: F.concat(F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/"), page.cast("string"))
    pages = placed.groupBy("c_nationkey", "page", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    more = F.when(F.col("page") < F.col("last"), F.concat(F.lit('<span class="more">'), at(F.col("page") + 1), F.lit("</span>"))).otherwise("")
    return pages.select("c_nationkey", "page", F.concat(F.lit("http://c.example"), at(F.col("page"))).alias("url"), F.concat(F.lit("<html><body><h1>n"), F.col("c_nationkey").cast("string"), F.lit("</h1><ul>"), "rows", F.lit("</ul>"), more, F.lit("</body></html>")).alias("html"))


def _people_reader(told: str, view: str) -> str:
    body = json.loads(view)["body"]
    if "who" in told:
        return json.dumps({"items": [{"who": unescape(n)} for n in re.findall(r'<li class="who">([^<]*)</li>', body)]})
    more = re.findall(r'<span class="more">([^<]*)</span>', body)
    return json.dumps({"items": [{"title": re.findall("<h1>([^<]*)</h1>", body)[0], "pagination": {"next_page_url": more[0]} if more else {}}]})


@_query("SELECT 'n' || c_nationkey AS title, least(3, ((count(*) + 9) // 10))::BIGINT AS pages, least(30, count(*))::BIGINT AS people, min(c_name) AS first FROM customer GROUP BY c_nationkey")
def paged_records(spark, sf):
    """A query with pagination: the people of a nation over three pages at most."""
    pages = _paged(spark, sf)
    query = "{ people[] { who } title pagination { next_page_url(url, optional) } }"
    rows, _ = ask.query_followed(pages.where("page = 0").select("url"), pages.select("url", "html"), query, _people_reader, max_pages=3, view="slim_html")
    return rows.where("_error IS NULL").select(F.col("data.title").alias("title"), "pages", F.size("data.people").cast("long").alias("people"), F.array_min(F.transform("data.people", lambda p: p["who"])).alias("first"))


def _asked_reader(told: str, view: str) -> str:
    if "json_schema" in told:
        return 'Here: {"json_schema": {"type": "object", "properties": {"name": {"type": "string"}, "price": {"type": ["number", "null"]}}, "required": ["name"]}}'
    found = re.findall(r'<h2 class="name">([^<]*)</h2></a><span class="price">\$([^<]*)</span>', json.loads(view)["body"])
    return json.dumps({"items": [{"name": unescape(n), "price": "$" + p} for n, p in found]})


@_query(f"SELECT p_brand, {_CARD_POS}, p_name AS name FROM part")
def asked_pages(spark, sf):
    """A request in words: the model names the schema, then reads one page of each template."""
    rows, _, _ = ask.ask_pages(_cards(spark, sf), "the name of every product", _asked_reader, view="slim_html")
    return rows.where("_error IS NULL").select("p_brand", F.col("pos").cast("long").alias("pos"), "name")


@_query("SELECT * FROM (VALUES ('{ a[] { b } }', 'struct<`a`:array<struct<`b`:string>>>'), ('{ a(int, currency) }', 'error'), ('{ a(unique, unique) }', 'error'), ('{ a(min_count) }', 'error'), ('{ a(colour) }', 'error'), ('{ a[] }', 'error'), ('{ n(int, optional) pagination { next_page_url } }', 'struct<`n`:bigint,`pagination`:struct<`next_page_url`:string>> paged'), ('{ a { b(bool) } # c', 'error')) t(query, told)")
def query_rules(spark, sf):
    """What the record language takes and refuses."""
    asked = ["{ a[] { b } }", "{ a(int, currency) }", "{ a(unique, unique) }", "{ a(min_count) }", "{ a(colour) }", "{ a[] }", "{ n(int, optional) pagination { next_page_url } }", "{ a { b(bool) } # c"]

    def told(query: str) -> str:
        try:
            root = dsl.parse(query)
        except ValueError:
            return "error"
        return dsl.spark_type(root) + (" paged" if dsl.has_pagination(root) else "")

    return spark.createDataFrame([(q, told(q)) for q in asked], "query string, told string")


@_query("SELECT * FROM (VALUES (0, 'Records with these fields:'), (1, '- title'), (2, '- items (list of)'), (3, '  - price as currency (may be missing)')) t(line, words)")
def query_words(spark, sf):
    """A query as a model is told it."""
    lines = dsl.describe(dsl.parse("{ title items[] { price(currency, optional) } }")).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, words string")


# Learning.


@_query("SELECT c_custkey, count(o_orderkey)::BIGINT AS rows, count(o_orderkey) % 2 = 0 AS heal FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def heal_checked(spark, sf):
    """A caller's test of each customer's rows; customers without rows call for healing too."""
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return extract.heal_flags(rows, ["c_custkey"], [], ["o_orderkey"], None, _t(spark, sf, "customer").select("c_custkey"), lambda part: len(part) % 2 == 1)


@_query("SELECT count(DISTINCT p_brand)::BIGINT AS templates, count(DISTINCT p_brand)::BIGINT AS questions, count(DISTINCT p_brand)::BIGINT AS learned, count(*)::BIGINT AS rows, 0::BIGINT AS failed FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) JOIN part USING (p_brand)")
def extraction_report(spark, sf):
    """What an extraction did, a template for each brand."""
    pages = _cards(spark, sf).withColumn("url", F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")), F.lit(".example/")))
    rows, _, asked = learn.extract_pages(pages, {"name": "string", "price": "currency"}, _flat_reader, required=["name"], view="slim_html")
    return models.explain(asked, rows)


def _flat_reader(told: str, view: str) -> str:
    return json.dumps({"items": [{"name": i["name"], "price": i["about"]["price"]} for i in json.loads(_card_reader(told, view))["items"]]})


@_query(f"SELECT p_brand, {_CARD_POS}, p_name AS name, p_size::DOUBLE AS price FROM part")
def healed_extraction(spark, sf):
    """Known plans that read the wrong element fail the caller's test, go, and are learned again."""
    pages = _cards(spark, sf)
    fields = {"name": "string", "price": "currency"}
    wrong = F.create_map(F.lit("name"), F.array(F.lit("span.price")), F.lit("price"), F.array(F.lit("span.price")))
    plans = extract.templates(pages, extract.signature(fields)).select("domain", "template", wrong.alias("plan")).dropDuplicates(["domain", "template"])
    rows, _, _ = learn.heal(pages, plans, fields, _flat_reader, ["name"], check=lambda part: not part["name"].str.startswith("$").any(), view="slim_html")
    return rows.where("_error IS NULL").select("p_brand", F.col("pos").cast("long").alias("pos"), "name", "price")


def _cleaning_model(told: str, view: str) -> str:
    """Stands for a model that cleans: JSON for some pages, plain text for others, nothing for the rest."""
    name = re.findall("<h1>([^<]*)</h1>", view)[0]
    key = int(re.findall(r"\d+", name)[0]) % 3
    return ('{"heading": "' + name + '", "items": ["one", "two"]}', f"# {name}\n- one\n- two", "")[key]


@_query("SELECT s_suppkey, s_name AS heading, CASE WHEN k < 2 THEN 'one;two' ELSE 'own text' END AS items, CASE WHEN k < 2 THEN 'model' ELSE 'rules' END AS by FROM (SELECT *, regexp_extract(s_name, '\\d+')::BIGINT % 3 AS k FROM supplier)")
def model_cleaned(spark, sf):
    """Pages cleaned by a model, in JSON or plain text, and by rules where it says nothing."""
    html = F.concat(F.lit("<html><body><h1>"), "s_name", F.lit("</h1><p>own text</p></body></html>"))
    made = learn.clean_pages(_t(spark, sf, "supplier").select("s_suppkey", html.alias("html")), "auto", _cleaning_model)
    items = F.filter("cleaned.items", lambda x: (x != F.col("cleaned.heading")) & ~F.startswith(x, F.lit("#")))
    return made.select("s_suppkey", "cleaned.heading", F.array_join(items, ";").alias("items"), F.col("cleaned_by").alias("by"))


class _Refused(Exception):
    def __init__(self, status_code: int):
        super().__init__(status_code)
        self.status_code = status_code


@_query("SELECT * FROM (VALUES ('fine', 1, 'answer'), ('limit', 3, 'answer'), ('timeout', 3, 'answer'), ('auth', 1, 'ModelAuthError'), ('other', 1, 'ModelError'), ('always', 3, 'ModelError')) t(failure, calls, told)")
def model_retries(spark, sf):
    """Which failures of a model are asked again, and how often."""
    kinds = {"fine": None, "limit": _Refused(429), "timeout": TimeoutError(), "auth": _Refused(401), "other": ValueError("x"), "always": _Refused(429)}
    out = []
    for name, error in kinds.items():
        calls = []

        def client(told: str, view: str, name=name, error=error, calls=calls) -> str:
            calls.append(1)
            if error is not None and (name == "always" or len(calls) < 3):
                raise error
            return "answer"

        try:
            told = models.with_retries(client, models.Retry(3, 0, 0, 0), sleep=lambda s: None)("", "")
        except ModelError as e:
            told = type(e).__name__
        out.append((name, len(calls), told))
    return spark.createDataFrame(out, "failure string, calls int, told string")


# Crawls and watches.

_EDGES = f"SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_replace(href, '#.*$', '') AS dst FROM (SELECT url, unnest({_ALL_LINKS}) AS href FROM pages)"


@_query(f"""
WITH RECURSIVE e AS ({_EDGES}), r AS (
  SELECT regexp_replace(url, '#.*$', '') AS url, 0 AS depth FROM (SELECT min(url) AS url FROM pages GROUP BY {_HOST})
  UNION
  SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 2
) SELECT url, min(depth)::INT AS depth FROM r GROUP BY 1
""")
def crawl_pages_table(spark, sf):
    """The links of all pages, from the first page of each host."""
    pages = _t(spark, sf, "pages")
    seeds = pages.groupBy(P.host(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    links = pages.select(F.col("url").alias("src"), F.posexplode(P.links(F.col("url"), F.col("html"))).alias("pos", "l")).select("src", "pos", F.col("l.url").alias("dst"))
    return crawl.crawl(seeds, links, max_depth=2, max_pages=10_000_000)


def _site(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as fetched earlier."""
    pages = _t(spark, sf, "pages")
    return pages.select(P.normal_link(F.col("url")).alias("url"), "html", F.lit(200).alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit(0).alias("tier"), F.to_timestamp(F.lit("2024-01-01")).alias("fetched_at"))


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").groupBy(P.host(F.col("url"))).agg(F.min("url").alias("url")).select("url")


def _nothing(url: str) -> fetching.Fetched:
    raise ConnectionError("no such page")


@_query(f"""
WITH RECURSIVE p AS (SELECT regexp_replace(url, '#.*$', '') AS url, arg_min(html, sha256(html)) AS html FROM pages GROUP BY 1),
e AS (SELECT DISTINCT url AS src, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_replace(href, '#.*$', '') AS dst FROM (SELECT url, unnest({_ALL_LINKS}) AS href FROM p)),
r AS (
  SELECT regexp_replace(url, '#.*$', '') AS url, 0 AS depth FROM (SELECT min(url) AS url FROM pages GROUP BY {_HOST})
  UNION
  SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 2
) SELECT r.url, min(depth)::INT AS depth, min(p.url) IS NULL AS failed FROM r LEFT JOIN p ON p.url = r.url GROUP BY 1
""")
def crawled_pages(spark, sf):
    """A crawl that fetches: pages from the cache, all others fail, and are told and not followed."""
    got = crawl.crawl_pages(_starts(spark, sf), {0: _nothing}, max_depth=2, max_pages=10_000_000, max_pending=10_000_000, cache=_site(spark, sf), per_second=0)
    return got.select("url", "depth", F.col("error").isNotNull().alias("failed"))


def _title_reader(told: str, view: str) -> str:
    return json.dumps({"items": [{"title": unescape(re.findall("<h1>([^<]*)</h1>", json.loads(view)["body"])[0])}]})


@_query(f"SELECT regexp_replace(url, '#.*$', '') AS url, replace(replace(replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages WHERE url IN (SELECT min(url) FROM pages GROUP BY {_HOST})")
def crawled_records(spark, sf):
    """The first pages of all hosts, crawled and read by a schema."""
    rows, _, _ = crawl.crawl_records(_starts(spark, sf), {0: _nothing}, _title_reader, "title string not null", learning={"view": "slim_html"}, max_depth=0, max_pages=10_000_000, cache=_site(spark, sf), per_second=0)
    return rows.where("_error IS NULL").select("url", "title")


@_query("""
SELECT 'https://shop.example/' || p_brand || '#' || k AS url, v::BIGINT AS version, field, old_value, new_value, type AS change_type FROM (
  SELECT p_brand, rn - 1 AS k, 1 AS v, 'name' AS field, NULL AS old_value, p_name AS new_value, 'added' AS type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
  UNION ALL SELECT p_brand, rn - 1, 1, 'price', NULL, (p_size)::DOUBLE::VARCHAR, 'added' FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
  UNION ALL SELECT p_brand, rn - 1, 2, 'price', (p_size)::DOUBLE::VARCHAR, (p_size * 10 + 5)::DOUBLE::VARCHAR, 'modified' FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part))
""")
def watched_pages(spark, sf):
    """Two versions of each brand's page as a stream; in the second every price has a digit more."""
    folder = _folder(spark, "watch")
    pages = _cards(spark, sf).select("url", F.lit(1).cast("long").alias("version"), "html")
    later = pages.withColumns({"version": F.lit(2).cast("long"), "html": F.regexp_replace("html", r"\$(\d+)", "\\$$15")})
    pages.unionByName(later).repartition(2, "version").write.parquet(f"{folder}/pages")
    stream = spark.readStream.schema(pages.schema).parquet(f"{folder}/pages")
    found = watch.watch_pages(stream, {"name": ["h2.name"], "price": ["span.price"]}, {"name": "string", "price": "currency"}, ["name"])
    watch.on_change(found, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}"), f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/changes").drop("batch")


@_query("SELECT p_partkey, p_size * 1.0 / 10 AS kilos FROM part")
def own_coercion(spark, sf):
    """A coercion of the caller's, by a pandas UDF, in a query of the record language."""

    @F.pandas_udf("double")
    def to_kilos(s: pd.Series) -> pd.Series:
        return s.str.removesuffix(" hg").astype("float64") / 10

    if "kilos" not in coerce.COERCIONS:
        coerce.register("kilos", "double", to_kilos)
    raw = F.to_json(F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" hg")).alias("weight")))
    return dsl.apply_query(_t(spark, sf, "part").select("p_partkey", raw.alias("raw")), "{ weight(kilos) }", "raw").select("p_partkey", F.col("data.weight").alias("kilos"))
