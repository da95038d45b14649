"""Sharding by sampled splitters, in DataFrame operations alone.

Records are ordered by a key that ends in a row number, so even rows alike in
every column can be parted. A sample drawn with probability in proportion to
size gives the quantiles of the bytes along that order; they cut it into many
more ranges than shards, between groups of equal texts where these are no larger
than a range. Ranges that prove overfull get splitters of a denser sample of
their own. Inside a range, running sums give every record its place in the whole
order, to the byte, so the shards' limits are exact.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_names, quoted, stored

_KEY = "struct<a:bigint,b:bigint,c:bigint,d:bigint>"
_LEAST = -(2**63)


@dataclass(frozen=True)
class ShardPlan:
    """Splitters of the ranges, and for each range what lies before it; bounded by the number of ranges.

    ``cuts``: for each shard but the first the rows before it.
    """

    shards: int
    total: int
    splitters: tuple[tuple, ...]
    bytes_before: tuple[int, ...]
    rows_before: tuple[int, ...]
    cuts: tuple[int, ...]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """A table of ``row`` (struct of ``columns``), ``size`` and ``key``: hash of the text, doc_id, hash of all columns, row number. Equal texts are neighbours."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.xxhash64(*[F.to_json(quoted(c)) if kind.startswith(("map", "variant")) else quoted(c) for c, kind in docs.dtypes])
    key = F.struct(F.xxhash64(text).alias("a"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("b"), whole.alias("c"), F.monotonically_increasing_id().alias("d"))
    return stored(docs.select(F.struct(*map(quoted, columns)).alias("row"), record_size(F.col("text").cast("string")).alias("size"), key.alias("key")), "keyed")


def _rank_in(splitters: list[tuple], key: Column) -> Column:
    """How many splitters are at or below the key: a binary search over a constant array."""
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    if not splitters:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([dict(zip("abcd", s)) for s in splitters])), f"array<{_KEY}>")

    def step(low: Column, by: Column) -> Column:
        return F.when((low + by <= len(splitters)) & (F.get(table, low + by - 1) <= key), low + by).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _sample(keys: DataFrame, share: Column, salt: int) -> list[tuple]:
    """Keys drawn with probability ``share``, by a hash, so a task that runs again draws the same."""
    unit = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return sorted(tuple(r) for r in keys.where(unit < share).select("key.*").collect())


def _between_groups(chosen: list[tuple]) -> list[tuple]:
    """Splitters moved to the start of their group of equal texts; inside a group only where it holds several."""
    out = []
    for k, key in enumerate(chosen):
        inside = k > 0 and chosen[k - 1][0] == key[0]
        out.append(key if inside else (key[0], _LEAST, _LEAST, _LEAST))
    return sorted(set(out))


def plan_shards(keys: DataFrame, shards: int = 40, ranges_per_shard: int = 8, rows_per_range: int = 250_000, samples_per_range: int = 16, max_ranges: int = 4096) -> ShardPlan:
    """Chooses the splitters and the shards' limits from a table of ``size`` and ``key``.

    To the driver come the sample and a row per range: about ``max_ranges`` x
    ``samples_per_range`` keys at most and, if ranges are overfull, four times
    as many more, however many rows there are. Beyond ``max_ranges`` ranges
    only grow, and are sorted with spilling.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * ranges_per_shard, min(max_ranges, -(-rows // rows_per_range)))
    drawn = _sample(keys, F.col("size") * (ranges * samples_per_range / max(1, total)), 0)
    splitters = _between_groups([drawn[k * len(drawn) // ranges] for k in range(1, ranges)]) if drawn else []

    def sizes() -> dict[int, tuple[int, int]]:
        return {r[0]: (r[1], r[2]) for r in keys.groupBy(_rank_in(splitters, F.col("key")).alias("r")).agg(F.sum("size"), F.count("*")).collect()}

    found = sizes()
    for salt in (1, 2):  # overfull: over twice a fair range in bytes or rows, as a sample can err
        fair = lambda x: max(x[0] * ranges / max(1, total), x[1] / max(rows_per_range, rows / ranges))  # noqa: E731, B023
        over = {r: math.ceil(fair(x)) for r, x in found.items() if fair(x) > 2}
        if not over:
            break
        inside = keys.where(_rank_in(splitters, F.col("key")).isin(list(over)))
        denser = _sample(inside, (F.col("size") / float(max(1, total)) + F.lit(1 / max(1, rows))) * (2.0 * ranges * samples_per_range), salt)
        limits = [(_LEAST,) * 4, *splitters, (2**63,) * 4]
        more = set(splitters)
        for r, parts in over.items():
            own = [k for k in denser if limits[r] <= k < limits[r + 1]]
            more.update(_between_groups([own[k * len(own) // (2 * parts)] for k in range(1, 2 * parts) if own]))
        splitters = sorted(more)
        found = sizes()
    bytes_before, rows_before = [0], [0]
    for r in range(len(splitters) + 1):
        own = found.get(r, (0, 0))
        bytes_before.append(bytes_before[-1] + own[0])
        rows_before.append(rows_before[-1] + own[1])
    plan = ShardPlan(shards, total, tuple(splitters), tuple(bytes_before), tuple(rows_before), ())
    first = _placed(keys, plan).groupBy("shard").agg(F.min("at")).collect()  # a row per shard
    start = {r[0]: r[1] for r in first}
    cuts = [rows] * (shards + 1)
    for s in reversed(range(shards)):
        cuts[s] = start.get(s, cuts[s + 1])
    return ShardPlan(shards, total, plan.splitters, plan.bytes_before, plan.rows_before, tuple(cuts[:-1]))


def _placed(keyed: DataFrame, plan: ShardPlan) -> DataFrame:
    """Adds ``at``, the record's number in the whole order, and ``shard``, where the middle of its bytes falls.

    A run of equal texts inside a range that fits in a hundredth of a shard goes by the middle of the whole run.
    """
    in_order = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("range", "key.a")
    constant = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    ranked = keyed.withColumn("range", _rank_in(list(plan.splitters), F.col("key"))).withColumns(
        {"bytes": F.coalesce(F.sum("size").over(in_order), F.lit(0)), "number": F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1}
    )
    ranked = ranked.withColumns({"run": F.sum("size").over(same), "run_at": F.min("bytes").over(same)})
    whole = F.col("run") * (100 * plan.shards) <= plan.total
    middle = F.get(constant(plan.bytes_before), F.col("range")) * 2 + F.when(whole, F.col("run_at") * 2 + F.col("run")).otherwise(F.col("bytes") * 2 + F.col("size"))
    shard = F.least(F.lit(plan.shards - 1), F.floor(middle.cast("decimal(30,0)") * plan.shards / F.lit(max(1, 2 * plan.total)).cast("decimal(30,0)")).cast("int"))
    return ranked.withColumns({"at": F.get(constant(plan.rows_before), F.col("range")) + F.col("number"), "shard": shard})


def shard_by_bytes(docs: DataFrame, shards: int = 40, columns: list[str] | None = None, **sizes: int) -> DataFrame:
    """Puts all records into shards of nearly equal bytes.

    ``docs`` needs doc_id and text. Returns ``columns`` (default: all, whatever
    their names) with ``__size``, ``__shard`` and ``__slot`` (gapless from 0 in
    each shard); these get more underscores where ``docs`` has such columns.
    ``sizes`` are parameters of ``plan_shards``.

    Every shard is a stretch of the order by (hash of the text, doc_id, hash of
    the row, row number), so equal texts lie together; a run of copies is cut
    only where it is larger than a hundredth of a shard. A shard differs from
    the mean by at most one record and one such run. Null text: 16 bytes, equal
    to the empty text. Null doc_ids come first. Rows alike in every column are
    interchangeable; they get places of their own. An empty table gives an
    empty result; a table smaller than the number of shards leaves shards
    empty. Very long texts are records like others.
    """
    columns = columns or docs.columns
    keyed = _keyed(docs, columns)
    plan = plan_shards(keyed, shards, **sizes)
    placed = _placed(keyed, plan)
    slot = F.col("at") - F.get(F.from_json(F.lit(json.dumps(plan.cuts)), "array<bigint>"), F.col("shard"))
    names = free_names(columns, "__size", "__shard", "__slot")
    return placed.select("row.*", F.col("size").alias(names[0]), F.col("shard").alias(names[1]), slot.alias(names[2]))
