"""Inventory of JSON endpoints from captured calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PAGE_KEYS = ("page", "offset", "cursor", "limit", "per_page", "page_size", "next", "after", "before")
AUTH = ("authorization", "x-api-key", "x-auth-token")
SENSITIVE = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")


def json_calls(calls: DataFrame) -> DataFrame:
    """Calls whose response says JSON and is JSON."""
    kind = F.lower(F.coalesce(F.try_element_at("response_headers", F.lit("content-type")), F.lit("")))
    return calls.where(kind.contains("application/json") & F.try_parse_json("response_body").isNotNull())


def endpoint_key(method: Column, url: Column, body: Column) -> Column:
    return F.concat_ws("\t", F.upper(method), url, F.substring(F.sha2(F.coalesce(body, F.lit("")), 256), 1, 24))


def distinct_endpoints(calls: DataFrame, order: str) -> DataFrame:
    """The first call of each (method, url, body)."""
    keyed = calls.withColumn("endpoint", endpoint_key(F.col("method"), F.col("url"), F.col("request_body")))
    w = Window.partitionBy("endpoint").orderBy(order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pagination_keys(url: Column, body: Column) -> Column:
    """Names of paging parameters in the query string or the JSON body, sorted."""
    query = F.map_keys(F.str_to_map(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("&"), F.lit("=")))
    names = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, PAGE_KEYS))
    return F.array_sort(F.array_intersect(F.transform(F.concat(query, names), F.lower), wanted))


def auth_headers(headers: Column) -> Column:
    """Names of the headers that carry credentials, in lower case, sorted; empty where there is none."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), F.lower), lambda k: k.isin(*AUTH))))


def redact(headers: Column) -> Column:
    """Values of sensitive headers replaced."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), F.lit("<redacted>")).otherwise(v))


def discover(calls: DataFrame, order: str) -> DataFrame:
    """The inventory of captured calls: the first of each endpoint that answers in JSON, its paging parameters, the names of its credential headers, and the schema of all its answers."""
    json = json_calls(calls).withColumn("endpoint", endpoint_key(F.col("method"), F.col("url"), F.col("request_body")))
    found = distinct_endpoints(json, order).withColumn("paging", pagination_keys(F.col("url"), F.col("request_body"))).withColumn("auth", auth_headers(F.col("request_headers")))
    return found.drop("request_headers", "response_headers", "response_body").join(infer_schemas(json), "endpoint")


def client_code(endpoints: list[dict]) -> str:
    """Source of a Python module with a function for each endpoint (method, url, request_body, names of its credential headers in ``auth``), which the caller's secrets are passed to."""
    out = ["import json", "from urllib.request import Request, urlopen", ""]
    for i, e in enumerate(endpoints, 1):
        out += ["", f"def endpoint_{i}(secrets):", f"    headers = {{name: secrets[name] for name in {sorted(e.get('auth') or [])!r}}}", f"    body = {e.get('request_body')!r}"]
        out += [f"    request = Request({e['url']!r}, body.encode() if body else None, headers, method={e['method'].upper()!r})", "    with urlopen(request) as answer:", "        return json.load(answer)", ""]
    return "\n".join(out)


def infer_schemas(calls: DataFrame, key: str = "endpoint", body: str = "response_body") -> DataFrame:
    """The schema of all bodies of each endpoint."""
    return calls.groupBy(key).agg(F.schema_of_variant_agg(F.try_parse_json(body)).alias("schema"), F.count("*").alias("calls"))


def captured_json(body: Column, content_type: Column, max_bytes: int) -> Column:
    """``json``: the body where it says JSON and is JSON; ``truncated`` and ``size`` instead where it is over ``max_bytes`` (0: no limit); null for all others."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    says = (kind.contains("application/json") | kind.contains("+json")) & (F.length(body) > 0)
    size = F.octet_length(body)
    large = (size > max_bytes) & F.lit(max_bytes > 0)
    made = lambda json, truncated, n: F.struct(json.cast("string").alias("json"), F.lit(truncated).alias("truncated"), n.cast("int").alias("size"))
    return F.when(says & large, made(F.lit(None), True, size)).when(says & F.try_parse_json(body).isNotNull(), made(body, False, F.lit(None)))


def captured_calls(pages: DataFrame, max_events: int = 200, max_bytes: int = 0) -> DataFrame:
    """The calls that pages recorded while they were fetched, a row each: url of the page, pos, and the call's own fields.

    ``pages`` has ``network``, an array of calls (method, url, request_headers,
    request_body, response_headers, response_body). At most ``max_events`` of a
    page and bodies of at most ``max_bytes`` (0: any) are kept, the capture's own
    limits; a longer body is null with its size in ``cut``.
    """
    each = pages.select(F.col("url").alias("page"), F.posexplode(F.slice("network", 1, max_events)).alias("pos", "call")).select("page", "pos", "call.*")
    size = F.octet_length("response_body")
    large = (size > max_bytes) & F.lit(max_bytes > 0)
    return each.withColumn("cut", F.when(large, size)).withColumn("response_body", F.when(~F.coalesce(large, F.lit(False)), F.col("response_body")))
