"""Page functions as columns. What needs the tree runs in Arrow batches, each page parsed once per call; the rest are SQL expressions."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import Node, Page
from .selectors import select, values

_BLOCK = re.compile(r"h[1-6]|p|br|li|tr|td|th|div|ul|ol|table|section|article|header|blockquote|pre")
# Fixed values.
_NOISE = re.compile(r"(cookie|consent|banner|subscribe|newsletter|promo|ad-|ads|advert|navbar|footer|header|modal)", re.I)


def _udf(kind: str, function: Callable):
    """A column function over (url, html) or (html), evaluated on Arrow batches."""
    if kind.startswith("struct"):  # a null struct can only travel inside an array
        inner = _udf(f"array<{kind}>", lambda *row: [x for x in [function(*row)] if x is not None])
        return lambda *columns: F.get(inner(*columns), F.lit(0))

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def css_text(html: Column, selector: str) -> Column:
    """Trimmed text of each match, in document order."""
    return _udf("array<string>", lambda h: values(Page(h), selector))(html)


def own_escapes(html: Column) -> Column:
    """The page with all character references literal but ``&amp;``, ``&lt;`` and ``&gt;``, what an escaper of texts writes; for reading texts that may hold other references, whole or cut, as text. Scripts change too."""
    return F.regexp_replace(html, "&(?!(?:amp|lt|gt);)", "&amp;")


def select_values(html: Column, selector: str) -> Column:
    """CSS or XPath; errors in an XPath give an empty list."""

    def run(h):
        try:
            return values(Page(h), selector)
        except ValueError:
            if not selector.lstrip().startswith(("/", "(")):
                raise
            return []

    return _udf("array<string>", run)(html)


_SCALAR = re.compile(r"\s*(count|string|sum|number|boolean|concat|normalize-space|string-length|substring|substring-before|substring-after|translate|not|contains|starts-with|floor|ceiling|round|name|local-name)\(")


def well_formed(html: Column) -> Column:
    """The page as XML: every element closed, names that XML forbids left out."""
    return _udf("string", lambda h: Page(h).xml())(html)


def xpath_values(html: Column, path: str) -> Column:
    """Attributes and texts that any XPath 1.0 path finds, or the one value of a function, by the JVM's own evaluator. Null or empty pages, and elements without ``text()``, give none."""
    xml = well_formed(html)
    value = F.array(F.xpath_string(xml, F.lit(path))) if _SCALAR.match(path) else F.filter(F.xpath(xml, F.lit(path)), lambda v: v.isNotNull())
    return F.when(F.coalesce(xml, F.lit("")) == "", F.array().cast("array<string>")).otherwise(value)


def first_of(html: Column, selectors: Sequence[str]) -> Column:
    """Fallback chain: values of the first selector that yields any text; selectors that fail are skipped."""

    def run(h):
        page = Page(h)
        for s in selectors:
            try:
                if any(found := values(page, s)):
                    return found
            except ValueError:
                continue
        return []

    return _udf("array<string>", run)(html)


def elements(html: Column, selector: str) -> Column:
    """Matches with attributes, text, canonical path and outer HTML."""

    def run(h):
        page = Page(h)
        return [{"pre": n.pre, "tag": n.tag, "attrs": n.attrs, "text": page.text(n).strip(), "xpath": page.xpath(n), "html": page.html(n)} for n in select(page, selector) if isinstance(n, Node)]

    return _udf("array<struct<pre:int,tag:string,attrs:map<string,string>,text:string,xpath:string,html:string>>", run)(html)


def nodes(html: Column) -> Column:
    """The whole tree: explode it to a relation and every axis is a comparison of pre, size, level and parent."""

    def run(h):
        page = Page(h)
        return [{"pre": n.pre, "size": n.size, "level": n.level, "parent": n.parent, "tag": n.tag, "attrs": n.attrs, "text": page.text(n).strip()} for n in page.nodes]

    return _udf("array<struct<pre:int,size:int,level:int,parent:int,tag:string,attrs:map<string,string>,text:string>>", run)(html)


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution; what cannot be resolved stays as it is."""

    def run(b, r):
        try:
            return None if r is None else urljoin(b or "", r)
        except ValueError:
            return r

    return _udf("string", run)(base, ref)


def links(url: Column, html: Column) -> Column:
    """Absolute targets of all links in order, repeats and fragments kept; external: another host, where a target without host counts as internal."""

    def run(u, h):
        page, out = Page(h), []
        own = urlsplit(u or "").netloc.lower()
        for n in page.nodes:
            if n.tag == "a" and "href" in n.attrs:
                try:
                    target = urljoin(u or "", n.attrs["href"].strip())
                    host = urlsplit(target).netloc.lower()
                except ValueError:
                    continue
                out.append({"href": n.attrs["href"], "url": target, "external": bool(host) and host != own})
        return out

    return _udf("array<struct<href:string,url:string,external:boolean>>", run)(url, html)


def tables(html: Column) -> Column:
    """Tables of rows of trimmed cells; rows and tables without cells are left out."""

    def run(h):
        page, out = Page(h), []
        for t in (n for n in page.nodes if n.tag == "table"):
            rows = [[page.text(c).strip() for c in page.children(r) if c.tag in ("td", "th")] for r in page.descendants(t) if r.tag == "tr"]
            if rows := [r for r in rows if r]:
                out.append(rows)
        return out

    return _udf("array<array<array<string>>>", run)(html)


def _scripts(page: Page, test: Callable[[Node], bool]) -> list[str]:
    return [page.text(n) for n in page.nodes if n.tag == "script" and test(n)]


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def json_ld(html: Column) -> Column:
    """JSON-LD objects, as JSON; members of lists one by one, bad JSON skipped."""

    def run(h):
        found = [_load(s) for s in _scripts(Page(h), lambda n: n.attrs.get("type", "").strip().lower() == "application/ld+json")]
        return [json.dumps(d, sort_keys=True, ensure_ascii=False) for x in found for d in (x if isinstance(x, list) else [x]) if isinstance(d, dict)]

    return _udf("array<string>", run)(html)


def hydration(html: Column) -> Column:
    """Embedded state of a page and where it was: the first of the two known script ids or an inline assignment that holds an object."""

    def run(h):
        page = Page(h)
        for source in ("__NEXT_DATA__", "__NUXT_DATA__"):
            for s in _scripts(page, lambda n: n.attrs.get("id") == source):
                if isinstance(data := _load(s), dict):
                    return {"source": source, "data": json.dumps(data, sort_keys=True, ensure_ascii=False)}
        for s in _scripts(page, lambda n: True):
            m = re.search(r"__NUXT__\s*=\s*(\{.*\})\s*;?\s*$", s, re.S)
            if m and isinstance(data := _load(m[1]), dict):
                return {"source": "__NUXT__", "data": json.dumps(data, sort_keys=True, ensure_ascii=False)}
        return None

    return _udf("struct<source:string,data:string>", run)(html)


def hydration_subset(data: Column) -> Column:
    """The page's properties, else its state, else its data, else all; as JSON."""
    return F.coalesce(*[F.get_json_object(data, p) for p in ("$.props.pageProps", "$.state", "$.data")], data)


def _metadata(page: Page) -> dict[str, str]:
    out: dict[str, str] = {}
    title = next((n for n in page.nodes if n.tag == "title"), None)
    if title is not None and (text := re.sub(r"[ \t\n\f\r]+", " ", page.text(title)).strip()):  # the parser has resolved its references, so marks in it are text
        out["title"] = text
    for n in page.nodes:
        key = n.attrs.get("property") or n.attrs.get("name") if n.tag == "meta" else None
        if key and n.attrs.get("content"):
            out[key] = n.attrs["content"]
    return out


def metadata(html: Column) -> Column:
    """Title and named metas; property before name, empty ones skipped, the later of two wins."""
    return _udf("map<string,string>", lambda h: _metadata(Page(h)))(html)


def _noise(node: Node) -> bool:
    return node.tag in ("script", "style", "noscript", "nav", "footer", "aside", "template") or bool(_NOISE.search(f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}"))


def _main_lines(page: Page) -> list[tuple[str, str]]:
    """Lines of the page without noise, each with the tag of the block that it begins; of the main element or the article alone, if there is just one."""
    if not page.nodes:
        return []
    alone = [found[0] for tag in ("main", "article") if len(found := [n for n in page.nodes if n.tag == tag]) == 1]
    root = next(iter(alone), next((n for n in page.nodes if n.tag == "body"), page.nodes[0]))
    lines: list[list[str]] = [[""]]  # the tag, then pieces of text
    stack: list[int | str | None] = [root.pre]
    while stack:
        top = stack.pop()
        if top is None:  # the end of a block
            lines.append([""])
        elif isinstance(top, str):
            lines[-1].append(top)
        elif top == root.pre or not _noise(page.nodes[top]):
            node = page.nodes[top]
            if _BLOCK.fullmatch(node.tag):
                lines.append([node.tag])
                stack.append(None)
            stack.extend(reversed(node.content))
    told = ((tag, " ".join("".join(parts).split())) for tag, *parts in lines)
    return [(tag, text) for tag, text in told if text]


def _main_text(page: Page) -> str:
    return "\n".join(text for _, text in _main_lines(page))


def _markdown(page: Page) -> str:
    mark = lambda tag: "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""
    return "\n\n".join(mark(tag) + text for tag, text in _main_lines(page))


def main_text(html: Column) -> Column:
    """The page's main text, a line for each block."""
    return _udf("string", lambda h: _main_text(Page(h)))(html)


def markdown(html: Column) -> Column:
    """The main text with marks for headings and list items, blocks apart by empty lines."""
    return _udf("string", lambda h: _markdown(Page(h)))(html)


def _heading(page: Page) -> str:
    told = ((tag, page.text(n).strip()) for tag in ("h1", "title") for n in [next((n for n in page.nodes if n.tag == tag), None)] if n is not None)
    return next((text for _, text in told if text), "")


def _items(text: str, heading: str) -> tuple[str, list[str]]:
    """Heading and items of marked text: points of lists, and other lines of up to 240 characters; the first marked heading, else the first item, stands in for a missing heading."""
    items: list[str] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line[0] == "#" and not heading:
            heading = line.lstrip("#").strip()
        elif line[0] in "-*":
            items.append(line.lstrip("-* ").strip())
        elif len(line) <= 240:
            items.append(line)
    return heading or (items[0][:120] if items else ""), items


def clean(html: Column, slim: bool = False, most: int | None = None) -> Column:
    """What a reader of the page needs: heading, markdown, items, flat_json (heading and items) and html_excerpt, the markup without noise. A page without elements gives empty ones. ``slim``: the excerpt alone where there is one, for a slim view needs no more, and of that ``most`` characters or some more."""

    def run(h):
        page = Page(h)
        if slim and (excerpt := page.html(page.nodes[0], _noise, most) if page.nodes else "").strip(" "):
            return {"heading": None, "markdown": None, "items": None, "flat_json": None, "html_excerpt": excerpt}
        text = _markdown(page)
        heading, items = _items(text, _heading(page))
        flat = json.dumps({"heading": heading, "items": items}, ensure_ascii=False)
        return {"heading": heading, "markdown": text, "items": items, "flat_json": flat, "html_excerpt": page.html(page.nodes[0], _noise) if page.nodes else ""}

    return _udf("struct<heading:string,markdown:string,items:array<string>,flat_json:string,html_excerpt:string>", run)(html)


def cleaned_state(data: Column, heading: Column, max_chars: int = 500_000) -> Column:
    """The fields of ``clean`` and ``tokens``, an estimate, for a page's embedded state: its JSON is the markdown and the only item. Null for state over ``max_chars`` characters, which is no reading matter."""
    items = F.array(data)
    flat = F.to_json(F.struct(F.coalesce(heading, F.lit("")).alias("heading"), items.alias("items")))
    tokens = F.greatest(F.lit(1), F.floor(F.length(data) / 4)).cast("long").alias("tokens")
    return F.when(F.length(data) <= max_chars, F.struct(F.coalesce(heading, F.lit("")).alias("heading"), data.alias("markdown"), items.alias("items"), flat.alias("flat_json"), F.lit("").alias("html_excerpt"), tokens))


def provenance(url: Column, fetched_at: Column, tier: Column, xpath: Column, from_plan: Column, model: Column | None = None, confidence: Column | None = None) -> Column:
    """Where a record comes from: page, time and tier of its fetch, path of its element, whether a known plan read it, the model that was asked, and how sure it is."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        url.alias("url"), fetched_at.cast("timestamp").alias("fetched_at"), F.coalesce(tier.cast("int"), F.lit(-1)).alias("fetch_tier"), F.coalesce(xpath, F.lit("")).alias("xpath"),
        F.when(from_plan, none("string")).otherwise(model if model is not None else none("string")).alias("model"), from_plan.cast("boolean").alias("from_plan"), (confidence if confidence is not None else none("double")).cast("double").alias("confidence"),
    )


def article(html: Column) -> Column:
    """Title (first h1, else the title), text, author, date and language."""

    def run(h):
        page = Page(h)
        meta = _metadata(page)
        h1 = next((page.text(n).strip() for n in page.nodes if n.tag == "h1"), None)
        pick = lambda *keys: next((meta[k] for k in keys if k in meta), None)
        return {"title": h1 or meta.get("title"), "text": _main_text(page), "author": pick("author", "article:author"), "published": pick("date", "article:published_time"), "language": pick("language")}

    return _udf("struct<title:string,text:string,author:string,published:string,language:string>", run)(html)


def repeated(page: Page, root: Node | None) -> dict[int, Node]:
    """Elements of the commonest (tag, class) below ``root`` with two or more, ties to the first."""
    named = [(n, (n.tag, c)) for n in (page.descendants(root) if root else ()) if (c := n.attrs.get("class", "").strip())]
    best = Counter(key for _, key in named).most_common(1)
    return {n.pre: n for n, key in named if best[0][1] >= 2 and key == best[0][0]} if best else {}


def detect_records(url: Column, html: Column) -> Column:
    """The commonest (tag, class) below body with two elements or more, ties to the first: text, path and first link of each."""

    def run(u, h):
        page = Page(h)
        out = []
        for n in repeated(page, next((n for n in page.nodes if n.tag == "body"), None)).values():
            href = next((d.attrs["href"] for d in page.descendants(n) if d.tag == "a" and "href" in d.attrs), None)
            out.append({"text": page.text(n).strip(), "xpath": page.xpath(n), "url": urljoin(u or "", href) if href else None})
        return out

    return _udf("array<struct<text:string,xpath:string,url:string>>", run)(url, html)


def skeleton(html: Column) -> Column:
    """The page's template: its tags in order, as a hash."""
    return F.xxhash64(_udf("string", lambda h: Page(h, bare=True).skeleton())(html))


def visible_length(html: Column) -> Column:
    """Characters of visible text: blocks of script, style and noscript and all tags out, white space closed up."""
    text = html
    # What counts as unseen, and the marks around it.
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", " "), r"\s+", " ")
    return F.length(F.trim(text))


def looks_like_shell(html: Column) -> Column:
    """Pages that only scripts fill: marks of frameworks, a request for scripts, 25 scripts and more, or no markup at all."""
    low = F.lower(F.coalesce(html, F.lit("")))
    has = lambda *marks: low.rlike("|".join(marks))
    # Fixed values.
    framework = has("__next_data__", "id=[\"']__next[\"']", "data-reactroot", "react-dom", "__nuxt")
    app = has("id=[\"']app[\"']") & has("webpack", "vite", "modulepreload")
    asks = has("<noscript") & has("enable javascript")
    return (low == "") | framework | app | asks | (F.regexp_count(low, F.lit("<script")) >= 25)


def looks_challenged(title: Column, headers: Column) -> Column:
    """Pages of a bot check in place of the content, by title or headers."""
    # Fixed values.
    waits = F.lower(F.coalesce(title, F.lit(""))).rlike("just a moment|checking your browser")
    marked = F.exists(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: (F.lower(e["key"]) == "cf-ray") | ((F.lower(e["key"]) == "set-cookie") & e["value"].contains("cf-ray")))
    return waits | F.coalesce(marked, F.lit(False))


def meaningful(html: Column) -> Column:
    """Enough visible text, or a long page that is no script shell with little text."""
    seen = visible_length(html)
    return (seen >= 500) | ((F.length(html) >= 8000) & ~(looks_like_shell(html) & (seen < 200)))


def host(url: Column) -> Column:
    """The authority, port and user included, else the first segment."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.split_part(url, F.lit("/"), F.lit(1))))


def normal_link(url: Column) -> Column:
    """http and https only, without fragment; else null."""
    return F.when(url.rlike(r"(?i)^https?://"), F.regexp_replace(url, "#.*$", ""))
