"""Crawls over a table of links, level by level."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequery.functions import pages as P
from pagequery.functions.pages import host, normal_link
from pagequery.session import shared_folder


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crawl-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def admitted(urls: DataFrame, hosts: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """URLs on allowed hosts that match a pattern anywhere."""
    out = urls
    if hosts:
        out = out.where(host(F.col("url")).isin(*[h.lower() for h in hosts]))
    return out.where(F.col("url").rlike(pattern)) if pattern else out


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 2, max_pages: int = 100, hosts: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Breadth-first search: url, depth, of at most ``max_pages`` pages.

    ``links`` has src, pos, dst. A page leads only to its own host. Each level
    joins the frontier with the links, drops what was seen and takes the first
    by (rank of the parent, position), so results do not depend on scheduling.
    The cap is the crawl's own limit.
    """
    first = admitted(seeds.select(normal_link(F.col("url")).alias("url")).where("url IS NOT NULL").distinct(), hosts, pattern)
    first = first.orderBy("url").limit(max_pages)  # bounded ahead of the window, which has one partition
    level = written(first.withColumn("rank", F.row_number().over(Window.orderBy("url"))).withColumn("depth", F.lit(0)))
    seen = level
    edges = links.select(normal_link(F.col("src")).alias("src"), "pos", normal_link(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").where(host(F.col("src")) == host(F.col("dst")))
    for depth in range(1, max_depth + 1):
        left = max_pages - seen.count()
        if left <= 0:
            break
        found = level.join(edges, level.url == edges.src).groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("rank", "pos", "dst")).alias("at"))
        found = admitted(found, hosts, pattern).join(seen.select("url"), "url", "left_anti").orderBy("at").limit(left)  # bounded by the cap
        level = written(found.withColumn("rank", F.row_number().over(Window.orderBy("at"))).select("url", "rank", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("url", "depth")


def crawl_pages(
    seeds: DataFrame, tiers: dict, max_depth: int = 2, max_pages: int = 100, max_pending: int = 5000, hosts: list[str] | None = None, pattern: str | None = None,
    on_page: Callable[[DataFrame, int], None] | None = None, on_error: Callable[[DataFrame, int], None] | None = None, seen: DataFrame | None = None, **fetching,
) -> DataFrame:
    """Breadth-first search that fetches: depth, rank and the columns of ``fetching.fetch`` of at most ``max_pages`` pages, failures counted.

    Each level is fetched by ``tiers`` (see ``fetching.fetch``), its links are
    read from the pages and lead to their own hosts. What waits for the next
    level is cut to ``max_pending`` URLs, in the order in which they were found;
    both caps are the crawl's own. ``on_page`` and ``on_error`` get the good and
    the failed pages of each level. URLs in ``seen`` (url) are not fetched.
    """
    from pagequery.operators.fetching import fetch

    level = admitted(seeds.select(normal_link(F.col("url")).alias("url")).where("url IS NOT NULL").distinct(), hosts, pattern)
    known = level.select("url") if seen is None else seen.select(normal_link(F.col("url")).alias("url"))
    level = level if seen is None else level.join(known, "url", "left_anti")
    level = level.orderBy("url").limit(max_pages).withColumn("rank", F.row_number().over(Window.orderBy("url")))
    done, fetched = None, 0
    for depth in range(max_depth + 1):
        level = written(level)
        here = level.count()
        if not here:
            break
        fetched += here
        got = written(fetch(level.select("url"), tiers, **fetching).join(level, "url").withColumn("depth", F.lit(depth)))
        done = got if done is None else done.unionByName(got)
        known = level.select("url") if depth == 0 and seen is None else known.unionByName(level.select("url"))
        for hook, part in ((on_page, got.where("error IS NULL")), (on_error, got.where("error IS NOT NULL"))):
            if hook is not None:
                hook(part, depth)
        left = max_pages - fetched
        if left <= 0 or depth == max_depth:
            break
        linked = got.where("error IS NULL").select("url", "rank", F.posexplode(P.links(F.col("url"), F.col("html"))).alias("pos", "l"))
        linked = linked.select("rank", "pos", normal_link(F.col("l.url")).alias("dst"), host(F.col("url")).alias("own")).where("dst IS NOT NULL").where(host(F.col("dst")) == F.col("own"))
        found = admitted(linked.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("rank", "pos", "dst")).alias("at")), hosts, pattern).join(known, "url", "left_anti")
        found = found.orderBy("at").limit(min(left, max_pending))  # bounded by the caps
        level = found.withColumn("rank", F.row_number().over(Window.orderBy("at"))).select("url", "rank")
    if done is None:
        return seeds.sparkSession.createDataFrame([], "url string, html string, status int, headers map<string,string>, tier int, fetched_at timestamp, error string, rank int, depth int")
    return done


def crawl_records(seeds: DataFrame, tiers: dict, client=None, schema=None, request: str | None = None, plans: DataFrame | None = None, learning: dict | None = None, **crawling) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crawls and extracts: records of the pages, all plans, the pages. Exactly one of ``schema`` (see ``schema.fields_of``) and ``request`` (in words) says what."""
    from pagequery.plans.ask import ask_pages
    from pagequery.plans.learn import extract_pages
    from pagequery.plans.schema import fields_of

    if (schema is None) == (request is None):
        raise ValueError("a crawl takes either a schema or a request")
    pages = crawl_pages(seeds, tiers, **crawling)
    good = pages.where("error IS NULL").select("url", "html")
    if request is not None:
        rows, known, _ = ask_pages(good, request, client, plans, **(learning or {}))
    else:
        fields, required = fields_of(schema)
        rows, known, _ = extract_pages(good, fields, client, plans, required=required, **(learning or {}))
    return rows, known, pages


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Locations of sitemaps (url, xml): url, kind, pos, loc; XML that is not well-formed gives kind unknown and no location."""
    @F.pandas_udf("struct<kind:string,locs:array<string>>")
    def read(xml: pd.Series) -> pd.DataFrame:
        from xml.etree import ElementTree

        def one(text):
            try:
                root = ElementTree.fromstring((text or "").strip())
            except ElementTree.ParseError:
                return {"kind": "unknown", "locs": []}
            kind = root.tag.rpartition("}")[2]
            locs = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()]
            return {"kind": kind, "locs": locs} if kind in ("urlset", "sitemapindex") else {"kind": "unknown", "locs": []}

        return pd.DataFrame([one(t) for t in xml])

    parsed = sitemaps.select("url", read("xml").alias("s"))
    return parsed.select("url", F.col("s.kind").alias("kind"), F.posexplode("s.locs").alias("pos", "loc"))


def expand_sitemaps(root: str, sitemaps: DataFrame, max_levels: int = 2, max_files: int = 20, max_pages: int = 1000) -> DataFrame:
    """Page URLs below a sitemap, through at most ``max_levels`` levels of indexes and ``max_files`` files, repeats kept; the caps are the operation's own."""
    found = sitemap_locations(sitemaps)
    here = found.where(F.col("url") == root)
    pages = here.where("kind = 'urlset'").select(F.lit(0).alias("level"), F.lit("").alias("file"), "pos", F.col("loc").alias("url"))
    for level in range(1, max_levels + 1):
        files = here.where("kind = 'sitemapindex'").orderBy("pos").limit(max_files - 1).select(F.col("loc").alias("file"), F.col("pos").alias("at"))
        here = files.join(found, files.file == found.url).select("url", "kind", (F.col("at") * 100_000 + F.col("pos")).alias("pos"), "loc")
        pages = pages.unionByName(here.where("kind = 'urlset'").select(F.lit(level).alias("level"), F.col("url").alias("file"), "pos", F.col("loc").alias("url")))
    return pages.orderBy("level", "pos").limit(max_pages).select("url")


def crawl_sitemap(root: str, sitemaps: DataFrame, pages: DataFrame, hosts: list[str] | None = None, pattern: str | None = None, max_pages: int = 1000) -> DataFrame:
    """The pages (url and more) that a sitemap lists and that are admitted, each once; no link is followed."""
    listed = admitted(expand_sitemaps(root, sitemaps, max_pages=max_pages).select(normal_link(F.col("url")).alias("_at")).where("_at IS NOT NULL").distinct().withColumnRenamed("_at", "url"), hosts, pattern)
    return pages.withColumn("_at", normal_link(F.col("url"))).join(listed.withColumnRenamed("url", "_at"), "_at", "left_semi").drop("_at")


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """URLs (trimmed, not blank, each once) that are not in ``seen``."""
    return urls.select(F.trim("url").alias("url")).where("trim(url) <> ''").distinct().join(seen.select(F.trim("url").alias("url")), "url", "left_anti")
