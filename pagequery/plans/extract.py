"""Extraction plans: selectors by field, kept for each template and applied to all its pages."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequery.functions.dom import Page
from pagequery.functions.pages import host, skeleton
from pagequery.functions.selectors import values

#: A plan table up to this number of characters of selectors is broadcast; a larger one is joined by a shuffle.
SMALL_PLANS = 4_000_000


def templates(pages: DataFrame, signature: str = "") -> DataFrame:
    """Adds domain and template, the key of a plan; ``signature`` tells schemas apart."""
    return pages.withColumn("domain", host(F.col("url"))).withColumn("template", F.concat_ws(":", skeleton(F.col("html")).cast("string"), F.lit(signature)))


def signature(schema: dict[str, str]) -> str:
    return ",".join(f"{k}:{v}" for k, v in sorted(schema.items()))


def matched(html: Column, plan: Column) -> Column:
    """For each field of a plan (map of field to selectors) the texts of the first selector that yields any, blank ones left out; the page is parsed once."""

    @F.pandas_udf("map<string,array<string>>")
    def run(h: pd.Series, p: pd.Series) -> pd.Series:
        def one(text, fields):
            if not fields:
                return {}
            page, out = Page(text), {}
            for name, selectors in dict(fields).items():
                out[name] = []
                for s in selectors:
                    try:
                        found = [v for v in values(page, s) if v]
                    except ValueError:
                        continue
                    if found:
                        out[name] = found
                        break
            return out

        return pd.Series([one(a, b) for a, b in zip(h, p)], dtype=object)

    return run(html, plan)


def _sizes(fields: list[str], found: str) -> Column:
    return F.array(*[F.coalesce(F.size(F.col(found)[f]), F.lit(0)) for f in fields])


def zip_error(fields: list[str], required: list[str] = (), found: str = "found") -> Column:
    """Why the matches of a page's fields can't be laid side by side (see ``zip_fields``); null where they can."""
    some = F.filter(_sizes(fields, found), lambda n: n > 0)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.size(F.col(found)[f]), F.lit(0)) == 0, F.lit(f)) for f in required])) if required else F.array().cast("array<string>")
    return F.when(F.size(F.array_distinct(some)) > 1, F.lit("unequal numbers of matches")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))


def zip_fields(pages: DataFrame, fields: list[str], required: list[str] = (), found: str = "found") -> DataFrame:
    """Lays the matches of the fields side by side: a row for each position.

    Fields with matches must have equally many, else the page is rejected with a
    reason in ``_error`` (one row without values); fields without any are null
    in every row, and a required one of these is a reason too. A page without
    any match gives one row of nulls.

    A row is made with all columns of ``pages`` but ``found``: large ones that
    nobody needs in each row are better dropped before.
    """
    none = F.struct(*[F.lit(None).cast("string").alias(f"_{i}") for i in range(len(fields))])
    each = F.arrays_zip(*[F.coalesce(F.col(found)[f], F.array().cast("array<string>")).alias(f"_{i}") for i, f in enumerate(fields)])
    laid = F.when(F.col("_error").isNull() & (F.array_max(_sizes(fields, found)) > 0), each).otherwise(F.array(none))
    kept = [c for c in pages.columns if c not in (found, "_error", "pos")]
    # the matches of a page end here: rows that carried them would grow with the square of its records
    spread = pages.withColumn("_error", zip_error(fields, required, found)).select(*kept, "_error", F.posexplode(laid).alias("pos", "_row"))
    return spread.select(*kept, "_error", "pos", *[F.col("_row")[f"_{i}"].alias(f) for i, f in enumerate(fields)])


def with_plans(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """Looks up each page's plan (domain, template, plan); null where there is none yet."""
    size = F.length(F.to_json(F.struct("plan"))) + F.length("domain") + F.length("template")
    small = (plans.agg(F.sum(size)).first()[0] or 0) <= SMALL_PLANS
    return pages.join(F.broadcast(plans) if small else plans, ["domain", "template"], "left")


def representatives(pages: DataFrame) -> DataFrame:
    """One page for each (domain, template), the first by url: what a plan is made from."""
    first = F.min_by(F.struct("url", "html"), "url")
    return pages.groupBy("domain", "template").agg(first.alias("p"), F.count("*").alias("pages")).select("domain", "template", "p.url", "p.html", "pages")


def upsert_plans(plans: DataFrame, new: DataFrame) -> DataFrame:
    """New plans replace those of the same key."""
    return plans.join(new.select("domain", "template").distinct(), ["domain", "template"], "left_anti").unionByName(new)


def invalidate(plans: DataFrame, keys: DataFrame) -> DataFrame:
    return plans.join(keys.select("domain", "template").distinct(), ["domain", "template"], "left_anti")


def induce_selectors(html: str, examples: dict[str, list[str]], cut: bool = False) -> dict[str, list[str]]:
    """Selectors whose values on a page equal the examples (or, where these were ``cut``, begin with them): by class, by attribute, by tag, then by path.

    A selector is tried once for a field, however many elements suggest it. A
    path finds one element, so it is tried where there is one example.
    """
    page = Page(html)
    named: dict[str, list[str]] = {}
    for name, wanted in examples.items():
        named.setdefault(wanted[0] if wanted else "", []).append(name)
    nodes: dict[str, list] = {}  # by text, those that a field begins with
    for n in page.nodes:
        if (text := page.text(n).strip()) in named:
            nodes.setdefault(text, []).append(n)
    out: dict[str, list[str]] = {}
    for name, wanted in examples.items():
        found: list[str] = []
        tried: set[str] = set()
        for n in nodes.get(wanted[0], ()) if wanted else ():
            options = [f"{n.tag}.{c}" for c in n.attrs.get("class", "").split()] + ([f"#{n.attrs['id']}"] if n.attrs.get("id") else []) + [n.tag] + ([page.xpath(n)] if len(wanted) == 1 else [])
            for s in options:
                if s in tried:
                    continue
                tried.add(s)
                try:
                    if values(page, s)[: len(wanted) if cut else None] == wanted:
                        found.append(s)
                except ValueError:
                    continue
        out[name] = found
    return out


def heal_flags(
    rows: DataFrame, keys: list[str], required: list[str], optional: list[str] = (), threshold: float | None = 0.9,
    expected: DataFrame | None = None, check: Callable[[pd.DataFrame], bool] | None = None,
) -> DataFrame:
    """Per key whether its rows call for a new plan.

    They do where a required field is null; where, without required fields, the
    share of rows that hold anything is below ``threshold`` (None: no such
    test); where a key of ``expected`` has no rows; and where the caller's
    ``check`` of a key's rows is false or fails. Without a ``check`` nothing
    leaves the JVM.
    """
    if required:
        bad = F.bool_or(F.array_contains(F.array(*[F.col(c).isNull() for c in required]), True))
    elif threshold is not None and optional:
        bad = F.avg(F.when(F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in optional]).isNotNull(), 1.0).otherwise(0.0)) < threshold
    else:
        bad = F.lit(False)
    out = rows.groupBy(*keys).agg(F.count("*").alias("rows"), bad.alias("heal"))
    if check is not None:
        kinds = dict(rows.dtypes)

        def judge(part: pd.DataFrame) -> pd.DataFrame:
            try:
                fails = not check(part)
            except Exception:  # a test that can't be made is no proof that the rows are good
                fails = True
            return part[keys].head(1).assign(_fails=fails)

        judged = rows.groupBy(*keys).applyInPandas(judge, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _fails boolean")
        out = out.join(judged, keys).select(*keys, "rows", (F.col("heal") | F.col("_fails")).alias("heal"))
    if expected is not None:
        out = expected.select(*keys).distinct().join(out, keys, "left").select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("heal", F.lit(True)).alias("heal"))
    return out


def field_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its nulls, empty strings and literal "None"."""
    counted = rows.agg(F.count("*").alias("rows"), *[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}__empty"), F.count_if(F.col(c).cast("string") == "None").alias(f"{c}__none"))])
    parts = ", ".join(f"'{c}', rows, `{c}__nulls`, `{c}__empty`, `{c}__none`" for c in columns)
    return counted.selectExpr(f"stack({len(columns)}, {parts}) AS (field, rows, nulls, empty, none)")


def plan_json(plan: dict[str, list[str]]) -> str:
    return json.dumps(plan, sort_keys=True)
