"""Readers of text that only nearly has a format: answers of models, robots files, names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> dict | None:
    """The JSON object that a text is, else the one that starts at its first brace; null without one."""
    bare = (text or "").strip()
    for at in (0, bare.find("{")):
        try:
            found = json.JSONDecoder().raw_decode(bare, at) if at > 0 else (json.loads(bare), 0)
        except ValueError:
            continue
        if isinstance(found[0], dict):
            return found[0]
    # text behind an object that begins the text
    try:
        found = json.JSONDecoder().raw_decode(bare)[0] if bare.startswith("{") else None
    except ValueError:
        found = None
    return found if isinstance(found, dict) else None


def loose_json(text: Column) -> Column:
    """``first_object`` as JSON with sorted keys."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return pd.Series([None if (found := first_object(t)) is None else json.dumps(found, sort_keys=True, ensure_ascii=False) for t in s], dtype=object)

    return read(text)


def without_fences(text: Column) -> Column:
    """Text without the lines that only open or close a code block, and without such marks at its very ends."""
    line = lambda x: F.lower(F.trim(x))
    kept = F.filter(F.split(F.trim(text), "\n"), lambda x: ~line(x).isin("```", "```json"))
    joined = F.trim(F.array_join(kept, "\n"))
    opened = F.when(F.startswith(F.lower(joined), F.lit("```json")), F.substr(joined, F.lit(8))).when(F.startswith(joined, F.lit("```")), F.substr(joined, F.lit(4))).otherwise(joined)
    return F.trim(F.when(F.endswith(opened, F.lit("```")), F.left(opened, F.length(opened) - 3)).otherwise(opened))


def crawl_delay(robots: Column) -> Column:
    """Seconds of the last readable Crawl-delay in a section for all agents; null without one. A line is what stands before a ``#``: a name up to the first colon, and a value."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), "\n"), lambda x: F.split_part(x, F.lit("#"), F.lit(1)))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.translate(F.substr(x, F.instr(x, F.lit(":")) + 1), "\r", "")).alias("value")))
    start = F.struct(F.lit(False).alias("all"), F.lit(None).cast("double").alias("delay"))

    def step(state: Column, pair: Column) -> Column:
        seconds = F.when(F.translate(pair["value"], "0123456789.", "") == "", pair["value"].try_cast("double"))
        named = F.when((pair["name"] == "user-agent") & (pair["value"] != ""), pair["value"] == "*").otherwise(state["all"])
        waits = F.when(state["all"] & (pair["name"] == "crawl-delay") & seconds.isNotNull(), seconds).otherwise(state["delay"])
        return F.struct(named.alias("all"), waits.alias("delay"))

    return F.aggregate(pairs, start, step)["delay"]


def safe_name(text: Column, most: int = 120, default: str = "session") -> Column:
    """A name for a file: every character that is no letter, digit, point, underscore or hyphen is an underscore; of ``most`` characters at most, ``default`` if there is none."""
    kept = F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}._-]", "_"), F.lit(most))
    return F.when(kept == "", F.lit(default)).otherwise(kept)


def type_name(prefix: str, text: Column) -> Column:
    """A name for a type: runs of other characters than ASCII letters, digits and underscores are one underscore, none at the ends; ``Model`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.when(kept == "", F.lit("Model")).otherwise(kept))
