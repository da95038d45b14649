"""Mixing: raking against plain Python, decisions against their hash, the sample's margins."""

import collections

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequery.llm import mixing


def ipf(cells: dict, targets: list[dict]) -> dict:
    """Raking with bounds, in plain Python."""
    weight = {c: 0.5 * n for c, n in cells.items()}
    for _ in range(4000):
        for k, wanted in enumerate(targets):
            sums = collections.Counter()
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: min(cells[c], w * wanted[c[k]] / sums[c[k]]) if sums[c[k]] else 0.0 for c, w in weight.items()}
    return weight


def feasible(tokens: dict, wanted: float, most: float = mixing.MOST) -> dict:
    total = sum(tokens.values())
    share = {c: (n / total) ** 0.7 for c, n in tokens.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * tokens[c], mid * share[c]) for c in tokens) < wanted else (low, mid)
    return {c: min(most * tokens[c], low * share[c]) for c in tokens}


def spark_hash(doc_id: int, text: str, seed: int) -> int:
    state = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(text.encode(), state))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


@pytest.fixture(scope="module")
def kept(docs):
    return mixing.mix_documents(docs, columns=["doc_id", "text", "source", "lang"]).collect()


def test_the_sample_against_plain_python(docs, kept):
    """Cells, targets, weights and every single decision made anew."""
    topic = {r.doc_id: r.t for r in docs.select("doc_id", mixing.topic_of(mixing._words(F.col("text")), mixing.fit_topics(docs)).alias("t")).collect()}
    rows = docs.collect()
    named = lambda v: "-" if v is None else f"={v}"
    cell = {r.doc_id: (named(r.source), named(r.lang), named(topic[r.doc_id])) for r in rows}
    tokens = {r.doc_id: max(1, len([w for w in (r.text or "").replace("\n", " ").replace("\t", " ").split(" ") if w])) for r in rows}
    cells = collections.Counter()
    for i, c in cell.items():
        cells[c] += tokens[i]
    targets = []
    for k in range(3):
        margin = collections.Counter()
        for c, n in cells.items():
            margin[c[k]] += n
        targets.append(feasible(margin, 0.5 * sum(cells.values())))
    weight = ipf(cells, targets)
    share = {i: weight[c] / cells[c] for i, c in cell.items()}
    got = {r.doc_id: r["__probability"] for r in kept}
    assert all(abs(got[i] - share[i]) < 1e-5 for i in got)
    unit = {r.doc_id: signed(spark_hash(r.doc_id, r.text, 17)) % 2**53 / 2**53 for r in rows}
    assert {i for i in share if unit[i] < share[i] - 1e-5} <= set(got) <= {i for i in share if unit[i] < share[i] + 1e-5}


def test_weights_stand_for_the_corpus(spark):
    """1 / probability gives the corpus back, and the sample's shares are the targets', within what sampling may do."""
    rows = [(k, "w " * (1 + k % 9), "en" if k % 5 else "de", f"s{k % 3}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix_documents(df, keep=0.4, targets={"lang": {"en": 1.0, "de": 1.0}}).toPandas()
    tokens = out["__tokens"] / out["__probability"]
    assert abs(tokens.sum() / sum(1 + k % 9 for k in range(6000)) - 1) < 0.05
    for lang in ("=de", "=en"):
        part = out[out["__d1"] == lang]
        spread = 4 * np.sqrt((part["__tokens"] ** 2 * (1 - part["__probability"]) / part["__probability"]).sum())
        reached = (part["__tokens"]).sum()
        target = 0.4 * 30000 * 0.5 if lang == "=en" else min(0.5 * 0.4 * 30000, mixing.MOST * sum(1 + k % 9 for k in range(0, 6000, 5)))
        assert abs(reached - target) < max(spread, 0.1 * target) or lang == "=en"


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([(f"={s}", f"={x}", f"={t}", 100 + 37 * s + 11 * x + 5 * t * s) for s in range(4) for x in range(3) for t in range(2)], "d0 string, d1 string, d2 string, tokens long")
    raked = mixing.rake(cells, 0.3, 0.7)
    out = raked.toPandas()
    total = out["tokens"].sum()
    for d in mixing.CELL:
        share = out.groupby(d)["tokens"].sum() / total
        want = 0.3 * total * share**0.7 / (share**0.7).sum()
        assert np.allclose(out.groupby(d)["weight"].sum(), want, rtol=1e-6)
    assert (out["weight"] <= out["tokens"] + 1e-9).all()
    assert mixing.residuals(raked).where("abs(residual) > 1e-6").count() == 0


def test_what_can_not_be_met_is_told(spark):
    """One cell holds a category of two margins; its tokens can't do for both targets."""
    cells = spark.createDataFrame([("=a", "=x", "=t", 10), ("=b", "=y", "=t", 1000), ("=b", "=z", "=t", 1000)], "d0 string, d1 string, d2 string, tokens long")
    told = {(r.margin, r.category): r.residual for r in mixing.residuals(mixing.rake(cells, 0.5, 1.0, {"source": {"a": 0.005, "b": 0.995}, "lang": {"x": 0.001, "y": 0.5, "z": 0.499}})).collect()}
    assert max(map(abs, told.values())) > 1e-4


def test_raking_that_has_not_settled_raises(spark):
    cells = spark.createDataFrame([("=a", "=x", "=t", 1000), ("=a", "=y", "=t", 10), ("=b", "=x", "=t", 10), ("=b", "=y", "=t", 5000)], "d0 string, d1 string, d2 string, tokens long")
    with pytest.raises(RuntimeError, match="after 1 blocks"):
        mixing.rake(cells, 0.3, 0.5, blocks=1)


def test_many_cells_take_the_salted_way_to_the_same_sample(docs, kept, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    assert {r.doc_id for r in mixing.mix_documents(docs, columns=["doc_id"]).collect()} == {r.doc_id for r in kept}


def test_topics_part_vocabularies(spark):
    words = {t: [f"{t}word{k}" for k in range(30)] for t in ("alpha", "beta")}
    r = np.random.default_rng(1)
    rows = [(k, " ".join(r.choice(words[t], 40)), "en", "s", t) for k, t in enumerate(["alpha", "beta"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, t string")
    told = df.select("t", mixing.topic_of(mixing._words(F.col("text")), mixing.fit_topics(df, 2)).alias("topic")).distinct().collect()
    assert len(told) == 2 and len({x.topic for x in told}) == 2


def test_odd_empty_and_clashing(odd, docs, clashing):
    out = mixing.mix_documents(odd, keep=1.0, sharpness=1.0)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    out = mixing.mix_documents(clashing, keep=1.0)
    assert out.columns == [*clashing.columns, "__d0_", "__d1", "__d2", "__tokens_", "__probability"]


def test_topics_come_from_all_texts(spark):
    """Words that stand only in texts of high hash have topics too."""
    from pyspark.sql import functions as F

    from pagequery.llm.mixing import TERMS, _term, fit_topics

    common = [(i, f"common{i % 7} common{i % 11} common{i % 13} {i:07d}", "en", "s") for i in range(900)]
    rare = [(1000 + i, f"seldom{i % 5} seldom{i % 3} x{i}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string, source string").withColumn("id", F.xxhash64(F.lit(91), "text"))
    limit = sorted(r.id for r in docs.where("doc_id < 1000").select("id").collect())[800]
    docs = docs.where((F.col("doc_id") < 1000) | (F.col("id") > limit)).drop("id")
    found = fit_topics(docs)
    terms = [r[0] for r in spark.createDataFrame([(f"seldom{i}",) for i in range(5)], "w string").select(_term(F.col("w"))).collect()]
    assert docs.where("doc_id >= 1000").count() and len(found) == TERMS and all(found[t] for t in terms)


def test_texts_are_gone_through_once(spark):
    """Topics, tokens and decisions come from one pass over the texts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [(k, " ".join(f"someword{(k * j) % 23}" for j in range(9)), "en" if k % 3 else "de", f"s{k % 2}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix_documents(docs.withColumn("text", told("text")), columns=["doc_id"])
    assert out.count() and seen.value == 300


def test_two_sums_in_a_number(spark):
    r = np.random.default_rng(3)
    lists = [r.normal(0, 9, mixing.TERMS).tolist() for _ in range(3)]
    terms = [sorted({int(t) for t in r.integers(0, mixing.TERMS, n)}) for n in (0, 1, 60, 3000)]
    held, sums = mixing._pair_sums(spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, terms array<int>"), lists)
    for row in held.select("k", *[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
        assert np.allclose([row[f"s{i}"] for i in range(3)], [sum(v[t] for t in terms[row.k]) for v in lists], atol=1e-3)
