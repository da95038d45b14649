"""Near-duplicate vectors against brute force and SQL."""

import numpy as np
import pytest
from conftest import DATA, rows_of

from pagequery.llm import embedding_dedup, queries


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    rows = [(int(i), [float(x) for x in base[i % 40] + 0.02 * (i % 3) * r.normal(size=16)]) for i in range(120)] + [(500, base[0].tolist()), (501, base[0].tolist()), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] * 16), (506, [1.0, 2.0]), (None, base[1].tolist())]
    got = {x.vec_id: x for x in embedding_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ok = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    for i, v in ok:
        links = sum(float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.95 for _, w in ok) - 1
        assert got[i].n_links == links
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (502, 503, 504, 505, 506)] == [(0, i, True) for i in (502, 503, 504, 505, 506)]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).fetchdf())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A bucket of many blocks gives the links of all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(9)
    base = r.normal(size=(3, 12))
    rows = [(i, [float(x) for x in base[i % 3] + 0.05 * r.normal(size=12)]) for i in range(150)]
    got = {x.vec_id: x for x in embedding_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    v = np.array([e for _, e in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    assert all(got[i].n_links == near[i].sum() - 1 for i in range(150))


def test_signatures_rarely_miss():
    r = np.random.default_rng(10)
    planes = r.normal(size=(64, embedding_dedup.SIGNS))
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    assert ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1).max() <= embedding_dedup.reach(0.95)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_near_duplicates(empty).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (None, [0.0, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS key", "1 AS id", "2 AS h")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
