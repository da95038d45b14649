"""Queries in the record language, and plain requests, run over pages."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequery.errors import SchemaError
from pagequery.functions.loose import first_object
from pagequery.functions.pages import clean, normal_link, resolve_url
from pagequery.operators.crawl import written
from pagequery.operators.text import choose_payload
from pagequery.plans import dsl
from pagequery.plans.learn import MAX_BODY, PLANS, ModelClient, extract_pages
from pagequery.plans.schema import fields_of

#: Schemas by page view and request, the oldest goes first.
_SCHEMAS: dict[str, dict] = {}
MOST_SCHEMAS = 128


def _flat(block: dsl.Block, prefix: str = "", optional: bool = False) -> dict[str, dsl.Field]:
    """The fields of a block and of the objects in it, names joined by two underscores."""
    out: dict[str, dsl.Field] = {}
    for c in block.children:
        if isinstance(c, dsl.Field):
            out[prefix + c.name] = c
        elif c.is_list:
            raise ValueError(f"{c.name}[] stands in a list; selectors give no lists of lists (raw records can be read by apply_query)")
        else:
            out |= _flat(c, f"{prefix}{c.name}__")
    return out


def _shaped(block: dsl.Block, prefix: str = "") -> list[Column]:
    """Columns of a block from flat ones: objects are structs again."""
    return [F.col(prefix + c.name).alias(c.name) if isinstance(c, dsl.Field) else F.struct(*_shaped(c, f"{prefix}{c.name}__")).alias(c.name) for c in {c.name: c for c in block.children}.values()]


def _faults(fields: dict[str, dsl.Field]) -> Column:
    found = [F.when(F.col(n).isNull(), F.lit(f"{n.replace('__', '.')}: missing")) for n, c in fields.items() if not c.optional]
    found += [F.when(F.size(n) < c.min_count, F.lit(f"{n.replace('__', '.')}: fewer than {c.min_count}")) for n, c in fields.items() if c.min_count is not None and c.coercion == "list"]
    return F.nullif(F.concat_ws("; ", *found), F.lit("")) if found else F.lit(None).cast("string")


def _read(pages: DataFrame, block: dsl.Block, single: bool, client: ModelClient, plans: DataFrame | None, options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the flat fields of a block and ``_error``; ``single`` wants one row of a page."""
    fields = _flat(block)
    needed = [n for n, c in fields.items() if not c.optional]
    rows, known, asked = extract_pages(pages, {n: c.coercion for n, c in fields.items()}, client, plans, required=needed, prompt=dsl.describe(block), **options)
    many = F.when((F.col("pos") > 0) & F.lit(single), F.lit("more than one record"))
    return rows.withColumn("_error", F.coalesce("_error", many, _faults(fields))), known, asked


def query_pages(pages: DataFrame, query: str, client: ModelClient, plans: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs ``query`` over ``pages`` (url, html): records, all plans, and what was asked (see ``extract_pages``).

    A query with one list gives a row per record of a page; one of fields and
    objects alone must find exactly one record in a page, and says so in
    ``_error`` where it does not. Records have the fields of the query, objects
    as structs, and ``_error``, also where a field that is not optional is
    missing or a list is shorter than asked. Queries with several lists, or
    with a list and other things, are for ``query_roots``.
    """
    root = dsl.parse(query)
    block = dsl.primary_list(root) or root
    if not block.children or any(isinstance(c, dsl.Block) and c.is_list for c in block.children):
        raise ValueError("a query for records has fields and objects, or one list of these")
    rows, known, asked = _read(pages, block, block is root, client, plans, options)
    names = list(_flat(block))
    return rows.select(*[c for c in rows.columns if c not in (*names, "_error")], *_shaped(block), "_error"), known, asked


def query_roots(pages: DataFrame, query: str, client: ModelClient, plans: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs ``query`` over ``pages`` (a row for each url): url, ``data`` (the whole tree of the query), ``_error``; all plans; what was asked.

    Each list is read by a plan of its own, in the order of the page, and what
    stands beside the lists by another, which must find one record. A list
    without records is empty; ``_error`` names the part that failed.
    """
    root = dsl.parse(query)
    lists = [c for c in root.children if isinstance(c, dsl.Block) and c.is_list]
    rest = dsl.Block("", False, tuple(c for c in root.children if c not in lists))
    plans = pages.sparkSession.createDataFrame([], PLANS) if plans is None else plans
    out, asked_all = pages.select("url").distinct().withColumn("_error", F.lit(None).cast("string")), None
    for block in [*lists, *([rest] if rest.children else [])]:
        rows, plans, asked = _read(pages.select("url", "html"), block, block is rest, client, plans, options)
        plans, asked_all = written(plans), asked if asked_all is None else asked_all.unionByName(asked)
        own = F.struct(*_shaped(block))
        if block is rest:
            part = rows.groupBy("url").agg(F.min_by(own, "pos").alias("_rest"), F.max("_error").alias("_why"))
        else:
            held = F.collect_list(F.when(F.col("_error").isNull(), F.struct("pos", own.alias("r"))))  # the records of a page
            part = rows.groupBy("url").agg(F.transform(F.array_sort(held), lambda x: x["r"]).alias("_l_" + block.name), F.max("_error").alias("_why"))
        why = F.concat(F.lit(block.name + ": " if block is not rest else ""), F.col("_why"))
        out = out.join(part, "url", "left").withColumn("_error", F.nullif(F.concat_ws("; ", "_error", why), F.lit(""))).drop("_why")
    at = lambda c: F.coalesce(F.col("_l_" + c.name), F.array().cast(dsl.spark_type(c))) if c in lists else F.col("_rest")[c.name]
    data = F.struct(*[at(c).alias(c.name) for c in {c.name: c for c in root.children}.values()])
    return out.select("url", data.alias("data"), "_error"), plans, asked_all


def query_followed(seeds: DataFrame, pages: DataFrame, query: str, client: ModelClient, plans: DataFrame | None = None, max_pages: int = 20, **options) -> tuple[DataFrame, DataFrame]:
    """Runs a query with ``pagination { next_page_url }`` over the pages that each seed (url) leads to: root, pages, ``data``, ``_error``; all plans.

    The next page of a page is what the query reads there, resolved against its
    URL. A root ends at a page without one, at one that it saw before or that
    ``pages`` lacks, or at ``max_pages``, the operation's own limit. The lists
    of a root's pages are united in their order without repeats, everything
    else is that of the last page.
    """
    root = dsl.parse(query)
    if not dsl.has_pagination(root):
        raise ValueError("the query does not ask for pagination { next_page_url }")
    table = pages.select(normal_link(F.col("url")).alias("_at"), "html").where("_at IS NOT NULL").groupBy("_at").agg(F.min_by("html", F.sha2(F.coalesce("html", F.lit("")), 256)).alias("html"))
    at = seeds.select(normal_link(F.col("url")).alias("root")).where("root IS NOT NULL").distinct().withColumn("_at", F.col("root"))
    done = None
    for page in range(max_pages):
        level = written(at.join(table, "_at"))
        if level.isEmpty():
            break
        found, plans, _ = query_roots(level.select(F.col("_at").alias("url"), "html").dropDuplicates(["url"]), query, client, plans, **options)
        here = written(level.select("root", F.col("_at").alias("url"), F.lit(page).alias("page")).join(found, "url"))
        done = here if done is None else done.unionByName(here)
        led = here.select("root", normal_link(resolve_url(F.col("url"), F.col("data.pagination.next_page_url"))).alias("_at")).where("_at IS NOT NULL")
        at = written(led.join(done.select("root", F.col("url").alias("_at")), ["root", "_at"], "left_anti"))
    if done is None:
        raise ValueError("no seed is among the pages")
    lists = [c.name for c in root.children if isinstance(c, dsl.Block) and c.is_list]
    united = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", F.col("data")[n].alias("l")))), lambda x: x["l"]))).alias(n) for n in lists]  # at most max_pages pages of a root
    last = F.max_by("data", "page")
    merged = done.groupBy("root").agg(*united, last.alias("_last"), F.count("*").alias("pages"), F.nullif(F.array_join(F.array_sort(F.collect_set("_error")), "; "), F.lit("")).alias("_error"))
    names = list(dict.fromkeys(c.name for c in root.children))
    data = F.struct(*[F.col(n) if n in lists else F.col("_last")[n].alias(n) for n in names])
    return merged.select("root", "pages", data.alias("data"), "_error"), plans


def synthesize(view: str, request: str, client: ModelClient) -> dict:
    """The JSON Schema of records that answer a request, as a model gives it for a page's view; the same question is asked once."""
    key = hashlib.sha256(f"{len(view)}:{view}{request}".encode("utf-8", "replace")).hexdigest()
    if key not in _SCHEMAS:
        answer = client(f"Answer with JSON: {{\"json_schema\": {{...}}}}, the JSON Schema of one record that answers this request: {request}", view)
        found = first_object(answer)
        found = found.get("json_schema", found) if found else None
        if isinstance(found, str):
            found = first_object(found)
        if not isinstance(found, dict):
            raise SchemaError("the model gave no schema", answer=str(answer)[:200])
        if len(_SCHEMAS) >= MOST_SCHEMAS:
            del _SCHEMAS[next(iter(_SCHEMAS))]
        _SCHEMAS[key] = found
    return _SCHEMAS[key]


def ask_pages(pages: DataFrame, request: str, client: ModelClient, plans: DataFrame | None = None, view: str = "auto", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers a plain request over ``pages`` (url, html): rows, all plans, and what was asked.

    The first page by url gives the view for which a model names the schema, on
    the driver; its fields are then read from all pages like those of a query.
    """
    first = pages.where("html IS NOT NULL").orderBy("url").limit(1).select(choose_payload(clean(F.col("html"), view == "slim_html", MAX_BODY), view, max_body=MAX_BODY).alias("view")).first()
    if first is None:
        raise ValueError("there is no page to ask about")
    fields, required = fields_of(synthesize(first.view, request, client))
    return extract_pages(pages, fields, client, plans, required=required, prompt=request, view=view, **options)


def answer(rows: DataFrame, fields: list[str]):
    """A small result in its plainest shape: the value of one row of one field, a list of the values of one field, else a list of objects. For results that a person reads."""
    found = rows.select(*fields).collect()
    if len(fields) == 1:
        return found[0][0] if len(found) == 1 else [r[0] for r in found]
    return [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in found]
