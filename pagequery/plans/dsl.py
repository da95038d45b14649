"""The record query language: ``{ items[] { name price(currency, optional) } }``.

A query is a tree of fields, objects and lists. It is parsed on the driver and
lowered to a Spark type and to expressions over raw records; nothing of it runs
row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequery.functions.coerce import COERCIONS

MODIFIERS = ("optional", "unique", "min_count")
_TOKEN = re.compile(r"\s*(?:(#[^\n]*)|([A-Za-z_]\w*)|(\[\])|([{}(),=])|(\d+))")


@dataclass(frozen=True)
class Field:
    name: str
    coercion: str = "string"
    optional: bool = False
    unique: bool = False
    min_count: int | None = None


@dataclass(frozen=True)
class Block:
    name: str
    is_list: bool
    children: tuple[Field | Block, ...]


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if not m[1]:
                self.tokens.append(next(filter(None, m.groups()[1:])))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise ValueError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def name(self) -> str:
        token = self.take()
        if not re.fullmatch(r"[A-Za-z_]\w*", token):
            raise ValueError(f"expected a name, found {token}")
        return token

    def children(self) -> tuple[Field | Block, ...]:
        self.take("{")
        out: list[Field | Block] = []
        while self.peek() != "}":
            if self.peek() == ",":
                self.take()
                continue
            out.append(self.node())
        self.take("}")
        return tuple(out)

    def node(self) -> Field | Block:
        name = self.name()
        is_list = self.peek() == "[]" and bool(self.take())
        if self.peek() == "{":
            return Block(name, is_list, self.children())
        if is_list:
            raise ValueError(f"{name}[] needs a block")
        return self.arguments(name) if self.peek() == "(" else Field(name)

    def arguments(self, name: str) -> Field:
        self.take("(")
        given: dict = {}
        while True:
            arg = self.name()
            if self.peek() == "=":
                self.take()
                value = self.take()
                if arg != "min_count" or not value.isdigit():
                    raise ValueError(f"bad value of {arg} on {name}: {value}")
            elif arg == "min_count":
                raise ValueError(f"min_count on {name} needs a number")
            else:
                value = True
            if arg in COERCIONS and arg != "string":
                arg, value = "coercion", arg
            elif arg not in MODIFIERS:
                raise ValueError(f"unknown argument of {name}: {arg}")
            if arg in given:
                raise ValueError(f"{arg} is given twice on {name}")
            given[arg] = int(value) if arg == "min_count" else value
            if self.peek() != ",":
                break
            self.take()
        self.take(")")
        return Field(name, **given)


def parse(query: str) -> Block:
    """The tree of a query; ValueError says what is wrong."""
    reader = _Reader(query)
    root = Block("", False, reader.children())
    if reader.peek():
        raise ValueError(f"unexpected {reader.peek()} behind the query")
    return root


def _unique_names(block: Block) -> dict[str, Field | Block]:
    return {c.name: c for c in block.children}  # the last of two wins


def spark_type(node: Field | Block) -> str:
    """DDL of the typed result."""
    if isinstance(node, Field):
        return COERCIONS[node.coercion][0]
    inner = f"struct<{','.join(f'`{n}`:{spark_type(c)}' for n, c in _unique_names(node).items())}>"
    return f"array<{inner}>" if node.is_list else inner


def raw_type(node: Field | Block) -> str:
    """DDL of raw records: the same shape, all fields strings."""
    if isinstance(node, Field):
        return "string"
    inner = f"struct<{','.join(f'`{n}`:{raw_type(c)}' for n, c in _unique_names(node).items())}>"
    return f"array<{inner}>" if node.is_list else inner


def coerce(node: Field | Block, value: Column, enforce_unique: bool = False) -> Column:
    """Typed value of a raw one. ``unique`` only acts where the caller asks for it."""
    if isinstance(node, Field):
        out = COERCIONS[node.coercion][1](value)
        if node.optional and node.coercion == "string":
            out = F.when(value.isNotNull(), out)
        return F.array_distinct(out) if enforce_unique and node.unique and node.coercion == "list" else out
    one = lambda v: F.struct(*[coerce(c, v[n], enforce_unique).alias(n) for n, c in _unique_names(node).items()])
    return F.transform(value, one) if node.is_list else one(value)


def violations(node: Field | Block, raw: Column, path: str = "") -> Column:
    """Array of what a raw record fails: required fields missing or unreadable, lists shorter than min_count."""
    if isinstance(node, Field):
        typed = coerce(node, raw)
        found = []
        if not node.optional:
            found.append(F.when(typed.isNull() | raw.isNull(), F.lit(f"{path}: missing")))
        if node.min_count is not None and node.coercion == "list":
            found.append(F.when(F.coalesce(F.size(typed), F.lit(0)) < node.min_count, F.lit(f"{path}: fewer than {node.min_count}")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    parts = lambda v: F.concat(*[violations(c, v[n], f"{path}.{n}".strip(".")) for n, c in _unique_names(node).items()] or [F.array().cast("array<string>")])
    return F.flatten(F.transform(raw, parts)) if node.is_list else parts(raw)


def apply_query(rows: DataFrame, query: str, raw: str, out: str = "data") -> DataFrame:
    """Parses the JSON column ``raw`` by the query: adds ``out`` (typed) and ``_errors``."""
    root = parse(query)
    parsed = F.from_json(F.col(raw), raw_type(root))
    return rows.withColumn(out, coerce(root, parsed)).withColumn("_errors", violations(root, parsed))


def has_pagination(root: Block) -> bool:
    """Whether the query asks for ``pagination { next_page_url }``."""
    return any(isinstance(c, Block) and c.name == "pagination" and any(x.name == "next_page_url" for x in c.children) for c in root.children)


def primary_list(root: Block) -> Block | None:
    """The one list of a root whose other fields are all optional."""
    lists = [c for c in root.children if isinstance(c, Block) and c.is_list]
    rest = [c for c in root.children if not (isinstance(c, Block) and c.is_list)]
    return lists[0] if len(lists) == 1 and all(isinstance(c, Field) and c.optional for c in rest) else None


def describe(root: Block) -> str:
    """The query in words, for a model's prompt."""
    def lines(b: Block, depth: int) -> list[str]:
        out = []
        for c in b.children:
            pad = "  " * depth + "- "
            if isinstance(c, Field):
                out.append(pad + c.name + (f" as {c.coercion}" if c.coercion != "string" else "") + (" (may be missing)" if c.optional else ""))
            else:
                out += [pad + c.name + (" (list of)" if c.is_list else ""), *lines(c, depth + 1)]
        return out

    return "\n".join(["Records with these fields:", *lines(root, 0)])
