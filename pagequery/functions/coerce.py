"""Coercions of the query language as SQL expressions; what cannot be read is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE = ("1", "true", "yes", "y", "in stock", "available")
FALSE = ("0", "false", "no", "n", "out of stock", "unavailable")


def _clean(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")


def to_string(value: Column) -> Column:
    return F.coalesce(_clean(value), F.lit(""))


def to_float(value: Column) -> Column:
    """Commas out, nothing else."""
    return F.replace(_clean(value), F.lit(","), F.lit("")).try_cast("double")


def to_int(value: Column) -> Column:
    """Through a float, cut toward zero."""
    return to_float(value).try_cast("bigint")


def to_currency(value: Column) -> Column:
    """Only digits, points and signs count."""
    return F.regexp_replace(F.replace(_clean(value), F.lit(","), F.lit("")), r"[^0-9.\-]+", "").try_cast("double")


def to_bool(value: Column) -> Column:
    """Text that neither list holds is true unless it is blank."""
    low = F.lower(_clean(value))
    return F.when(value.isNull(), F.lit(None).cast("boolean")).when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).otherwise(low != "")


def to_url(value: Column) -> Column:
    return F.nullif(_clean(value), F.lit(""))


def to_date(value: Column) -> Column:
    s = _clean(value)
    return F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(p)) for p in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")])


def to_list(value: Column) -> Column:
    """Parts between commas, semicolons and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value.cast("string"), "[,;\n]+"), _clean), lambda x: x != "")


def to_json(value: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.try_parse_json(value.cast("string")))


#: Name of a coercion: type and expression.
COERCIONS = {
    "string": ("string", to_string), "int": ("bigint", to_int), "float": ("double", to_float), "currency": ("double", to_currency), "bool": ("boolean", to_bool),
    "url": ("string", to_url), "iso_date": ("timestamp", to_date), "list": ("array<string>", to_list), "json": ("string", to_json),
}


def register(name: str, kind: str, made: Callable[[Column], Column]) -> None:
    """Adds a coercion of the caller's, an expression (or a pandas UDF applied) from a string to a value of type ``kind``; queries then know its name."""
    if not name.isidentifier() or name in _OWN:
        raise ValueError(f"a coercion needs a new name: {name!r}")
    COERCIONS[name] = (kind, made)


_OWN = frozenset(COERCIONS)
