"""Multi-index hashing: recall against brute force, pigeonhole completeness, what is touched."""

import numpy as np
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequery.llm import multi_index, queries


def test_search_recall_and_ties(spark):
    sf = DATA.replace("sf0.001", "sf0.1")
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.array(p["embedding"].tolist()).astype(float), p["vec_id"].to_numpy()
    got = queries.op10_multi_index(spark, sf).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own["score"]) <= 0).all()
        hits += (own["score"] >= np.sort(scores)[-20] - 1e-12).sum()
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in multi_index.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 64))
def test_probing_finds_every_code_within_the_radius(seed, radius):
    r = np.random.default_rng(seed)
    codes = r.integers(0, 256, (300, 8), dtype=np.uint8)
    codes[:100] = codes[0] ^ (r.random((100, 8)) < 0.2).astype(np.uint8)
    got = multi_index.MultiIndex(codes).within(codes[0], radius)
    assert got.tolist() == np.flatnonzero(multi_index.distances(codes, codes[0]) <= radius).tolist()


def test_dense_places_are_probed_little():
    """On vectors in clusters a query touches a small share of the rows, and still finds its nearest."""
    r = np.random.default_rng(12)
    centres = r.normal(size=(200, 64))
    x = np.repeat(centres, 40, axis=0) + 0.25 * r.normal(size=(8000, 64))
    x = x[r.permutation(len(x))]
    ids = np.arange(len(x))
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    model = multi_index.fit_codes(x[:4000], longest, 20)
    queries_ = ids[::80]
    bounds = multi_index.bounds_of(ids[:4000], x[:4000], queries_, x[queries_], 10)
    radii = model.radius(x[queries_], bounds)
    index, hits = multi_index.MultiIndex(model.codes(x, True)), 0
    for n, code in enumerate(model.codes(x[queries_], False)):
        rows = index.within(code, int(radii[n]))
        scores = x @ x[queries_[n]]
        scores[queries_[n]] = -np.inf
        hits += len(set(np.argsort(-scores)[:10]) & set(rows.tolist()))
    touched = index.touched / (len(queries_) * len(x))
    print(f"touched {touched:.3f} of the rows, recall {hits / (10 * len(queries_)):.3f}")
    assert touched < 0.35 and hits >= 0.9 * 10 * len(queries_)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (None, [9.0, 9.0]), (2, []), (3, [1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS part", "1 AS h", "2 AS block")
    got = [(r["rank"], r.vec_id, r.score) for r in multi_index.nearest_neighbours(df, df.where("vec_id = 0").unionAll(df.where("vec_id = 0"))).orderBy("rank").collect()]
    assert got == [(1, 1, 4.0), (2, 1, 4.0)]
    assert multi_index.nearest_neighbours(df.limit(0), df).count() == multi_index.nearest_neighbours(df, df.limit(0)).count() == 0
