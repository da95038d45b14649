"""Pages that lead to their next page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequery.functions.pages import first_of, normal_link, resolve_url
from pagequery.operators.crawl import written


def follow(seeds: DataFrame, pages: DataFrame, selectors: Sequence[str], max_pages: int = 20) -> DataFrame:
    """The pages that each seed (url) leads to, itself first: root, page (from 0), url, html.

    The next page of a page is the first value that the first fruitful one of
    ``selectors`` gives (``//a[@class='next']/@href``), resolved against its URL.
    A root ends at a page that has none, that it saw before, that is not in
    ``pages`` or at ``max_pages``, the operation's own limit. URLs count without
    fragments; of several rows with one URL the one with the least hash counts.
    Only pages on the way are parsed.
    """
    at = seeds.select(normal_link(F.col("url")).alias("root")).where("root IS NOT NULL").distinct().withColumn("_at", F.col("root"))
    table = pages.select(normal_link(F.col("url")).alias("_at"), "url", "html").where("_at IS NOT NULL")
    out = None
    for page in range(max_pages):
        one = F.min_by(F.struct("url", "html"), F.struct(F.sha2(F.coalesce("html", F.lit("")), 256), "url"))
        here = at.join(table, "_at").groupBy("root", "_at").agg(one.alias("p")).select("root", F.lit(page).alias("page"), "_at", "p.url", "p.html")
        here = written(here.withColumn("_next", resolve_url(F.col("url"), F.get(first_of(F.col("html"), selectors), F.lit(0)))))
        out = here if out is None else out.unionByName(here)
        led = here.select("root", normal_link(F.col("_next")).alias("_at")).where("_at IS NOT NULL")
        at = written(led.join(out.select("root", "_at"), ["root", "_at"], "left_anti"))
        if at.isEmpty():
            break
    return out.select("root", "page", "url", "html")
