"""Shards of equal bytes: sizes, slots, groups of equal texts, rows alike in every column."""

import pytest
from pyspark.sql import functions as F

from pagequery.llm import sharding


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    rows = sharding.shard_by_bytes(df, 4).select("doc_id", "text", "__size", "__shard", "__slot").collect()
    assert len(rows) == df.count() and all(r["__size"] == 16 + len((r.text or "").encode()) for r in rows)
    for s in range(4):
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(sum(r["__shard"] == s for r in rows)))
    largest, total = max(r["__size"] for r in rows), sum(r["__size"] for r in rows)
    for s in range(4):
        assert abs(sum(r["__size"] for r in rows if r["__shard"] == s) - total / 4) <= largest + total / 100


def test_equal_texts_stay_together(docs):
    rows = sharding.shard_by_bytes(docs, 4).groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("__shard").alias("shards"), F.first("__size").alias("size")).where("n > 1").collect()
    total = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0]
    assert rows and all(r.shards == 1 for r in rows if r.n * r["size"] * 400 <= total)


def test_rows_alike_in_every_column_are_parted(spark):
    alike = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    keyed = sharding._keyed(alike, alike.columns)
    plan = sharding.plan_shards(keyed, 4, rows_per_range=1000)
    sizes = [r[1] for r in keyed.groupBy(sharding._rank_in(list(plan.splitters), F.col("key")).alias("r")).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 2500
    rows = sharding.shard_by_bytes(alike, 4).select("__shard", "__slot").collect()
    for s in range(4):
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(5000))


def test_the_order_is_that_of_the_keys(docs):
    """Against a plain sort: shards are stretches of the order, slots the places in them."""
    rows = sharding.shard_by_bytes(docs, 5, ["doc_id", "text"]).withColumn("a", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    rows.sort(key=lambda r: (r["__shard"], r["__slot"]))
    keys = [(r.a, r.doc_id if r.doc_id is not None else -(2**63)) for r in rows]
    assert keys == sorted(keys)


def test_empty_and_clashing(docs, clashing):
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    out = sharding.shard_by_bytes(clashing, 3)
    assert out.columns == [*clashing.columns, "__size_", "__shard_", "__slot"] and sorted(r["__size"] for r in out.collect()) == sorted(f"__size{k}" for k in range(20))
