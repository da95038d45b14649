"""Record types from JSON Schema and back."""

from __future__ import annotations

import dataclasses
import datetime
import importlib
import importlib.util
import re
import typing

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

_PLAIN = {"string": StringType, "integer": LongType, "number": DoubleType, "boolean": BooleanType}


def spark_type(schema: dict) -> DataType:
    """The type of a JSON Schema: objects with properties are structs, arrays need items (else strings), of several types the first that is not null counts, everything else is text."""
    if not isinstance(schema, dict):
        raise ValueError("a schema is an object")
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    options = [o for o in schema.get("anyOf", []) + schema.get("oneOf", []) if isinstance(o, dict) and o.get("type") != "null"]
    if kind is None and options:
        return spark_type(options[0])
    if kind == "object" or (kind is None and isinstance(schema.get("properties"), dict)):
        named = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        needed = schema.get("required") if isinstance(schema.get("required"), list) else []
        fields = [StructField(n, spark_type(s if isinstance(s, dict) else {}), n not in needed) for n, s in named.items()]
        return StructType(fields) if fields else StringType()
    if kind == "array":
        return ArrayType(spark_type(schema.get("items") if isinstance(schema.get("items"), dict) else {}))
    return _PLAIN.get(kind, StringType)()


def schema_line(fields: dict[str, str]) -> str:
    """Fields and types in a line, for a prompt."""
    return ", ".join(f"{name}: {kind}" for name, kind in fields.items())


_COERCION = {"string": "string", "integer": "int", "number": "float", "boolean": "bool", "array": "list"}
_SPARK = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool", "timestamp": "iso_date", "date": "iso_date"}


def _of_json(schema: dict, prefix: str = "") -> tuple[dict[str, str], list[str]]:
    fields, needed = {}, []
    if schema.get("type") == "array" and isinstance(schema.get("items"), dict):
        return _of_json(schema["items"], prefix)
    named = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    for name, own in named.items():
        own = own if isinstance(own, dict) else {}
        kind = next((o.get("type") for o in [own, *own.get("anyOf", []), *own.get("oneOf", [])] if isinstance(o, dict) and o.get("type") not in (None, "null")), "string")
        kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
        if kind == "object":
            inner, must = _of_json(own, f"{prefix}{name}__")
            fields |= inner
            needed += must if name in schema.get("required", []) else []
        else:
            fields[prefix + name] = _COERCION.get(kind, "string")
            needed += [prefix + name] if name in schema.get("required", []) else []
    return fields, needed


def _of_type(kind: StructType, prefix: str = "") -> tuple[dict[str, str], list[str]]:
    fields, needed = {}, []
    for f in kind.fields:
        if isinstance(f.dataType, StructType):
            inner, must = _of_type(f.dataType, f"{prefix}{f.name}__")
            fields |= inner
            needed += [] if f.nullable else must
        else:
            fields[prefix + f.name] = "list" if isinstance(f.dataType, ArrayType) else _SPARK.get(f.dataType.simpleString(), "string")
            needed += [] if f.nullable else [prefix + f.name]
    return fields, needed


def _of_class(owner: type) -> tuple[dict[str, str], list[str]]:
    """Annotated classes: dataclasses and others; a field that may be None or has a default is not required."""
    fields, needed = {}, []
    for name, kind in typing.get_type_hints(owner).items():
        parts = [p for p in typing.get_args(kind) if p is not type(None)]
        maybe = type(None) in typing.get_args(kind)
        plain = parts[0] if maybe and parts else kind
        made = typing.get_origin(plain) or plain
        fields[name] = {str: "string", int: "int", float: "float", bool: "bool", list: "list", datetime.datetime: "iso_date", datetime.date: "iso_date"}.get(made, "string")
        if not maybe and not hasattr(owner, name) and getattr(getattr(owner, "__dataclass_fields__", {}).get(name), "default_factory", dataclasses.MISSING) is dataclasses.MISSING:
            needed.append(name)
    return fields, needed


def fields_of(ref) -> tuple[dict[str, str], list[str]]:
    """Fields (name to coercion) and the required ones of a schema in any form.

    A StructType, a JSON Schema, a class that gives its JSON Schema
    (``model_json_schema``) or has annotations, a query of the record language,
    DDL (``name string, price double``), or where to find one of these:
    ``package.module:Name`` or ``file.py:Name``. Objects inside are flat, names
    joined by two underscores. ValueError says what is wrong.
    """
    if isinstance(ref, StructType):
        return _of_type(ref)
    if isinstance(ref, dict):
        found = _of_json(ref)
    elif isinstance(ref, type):
        found = _of_json(ref.model_json_schema()) if hasattr(ref, "model_json_schema") else _of_class(ref)
    elif isinstance(ref, str) and ref.lstrip().startswith("{"):
        from pagequery.plans import ask, dsl

        root = dsl.parse(ref)
        flat = ask._flat(dsl.primary_list(root) or root)
        found = {n: c.coercion for n, c in flat.items()}, [n for n, c in flat.items() if not c.optional]
    elif isinstance(ref, str) and re.fullmatch(r"[^\s:,]+:[A-Za-z_]\w*", ref) and ("." in ref or "/" in ref):
        place, _, name = ref.rpartition(":")
        return fields_of(getattr(_module(place), name))
    elif isinstance(ref, str):
        return _of_type(StructType.fromDDL(ref))
    else:
        raise ValueError(f"not a schema: {ref!r}")
    if not found[0]:
        raise ValueError("the schema has no fields")
    return found


def _module(place: str):
    if not place.endswith(".py"):
        return importlib.import_module(place)
    spec = importlib.util.spec_from_file_location("pagequery_schema_file", place)
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    return made
