"""The weak-label classifier: known accuracies, held labels, plain recomputation."""

import numpy as np
from conftest import DATA

from pagequery.llm import weak_quality


def test_quality_against_labels(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    scored = weak_quality.quality_scores(df, weak_quality.fit_quality(df)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = scored[scored["quality"] == 1]
    assert (scored["__kept"] == (scored["quality"] == 1)).mean() > 0.98 and good["__kept"].mean() > 0.99


def test_quality_on_odd_rows(odd):
    out = weak_quality.quality_scores(odd, weak_quality.fit_quality(odd)).collect()
    assert len(out) == odd.count() and not any(r["__kept"] for r in out if not (r.text or "").strip())


def test_known_accuracies_are_recovered():
    """Votes drawn from labellers of known reliability: EM finds how often each is right, and the share of good texts."""
    r = np.random.default_rng(6)
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.85, 0.65, 0.9, 0.8])
    good = r.random(40_000) < 0.7
    votes = np.where(r.random((40_000, 9)) < right, good[:, None], ~good[:, None])
    votes = np.where(r.random((40_000, 9)) < 0.2, weak_quality.NOTHING, np.where(votes, weak_quality.GOOD, weak_quality.BAD))
    patterns, counts = np.unique([weak_quality.pattern_of(tuple(v)) for v in votes], return_counts=True)
    model = weak_quality.fit_label_model(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.02
    spoken = model.given[1, :, weak_quality.GOOD] / (model.given[1, :, weak_quality.GOOD] + model.given[1, :, weak_quality.BAD])
    assert np.abs(spoken - right).max() < 0.03
    told = model.posterior(np.array([weak_quality.pattern_of(tuple(v)) for v in votes[:5000]])) > 0.5
    assert (told == good[:5000]).mean() > 0.97


def test_scores_against_plain_python(docs):
    model = weak_quality.fit_quality(docs)
    for r in weak_quality.quality_scores(docs, model).collect():
        want = weak_quality.score(model.weights, weak_quality.hashed_features(r.text)) if r.text.strip() else 0.0
        votes = np.array([weak_quality.pattern_of(weak_quality.votes(r.text))])
        assert abs(r["__score"] - want) < 1e-12 and r["__kept"] == (want >= 0.35) and abs(r["__posterior"] - model.labels.posterior(votes)[0]) < 1e-12


def test_training_is_bounded_by_rows_and_characters(docs, monkeypatch):
    seen = []
    train = weak_quality.train_scorer
    monkeypatch.setattr(weak_quality, "train_scorer", lambda features, labels, *more: seen.append(features) or train(features[:2], labels[:2], 1))
    weak_quality.fit_quality(docs, train_rows=30)
    weak_quality.fit_quality(docs, train_bytes=20_000)
    assert len(seen[0]) == 30 and 0 < sum(len(h) for h, _ in seen[1]) <= 2 * 20_000
    weak_quality.fit_quality(docs, train_bytes=1)
    assert len(seen[2]) == 1


def test_empty_ties_and_clashing(docs, clashing):
    assert weak_quality.keep_good(docs.limit(0)).count() == 0
    out = weak_quality.quality_scores(clashing, weak_quality.fit_quality(clashing))
    assert out.columns == [*clashing.columns, "__posterior", "__score", "__kept_"]
    assert weak_quality.keep_good(clashing).columns == clashing.columns
    twice = weak_quality.quality_scores(docs.unionByName(docs), weak_quality.fit_quality(docs)).groupBy("doc_id").agg({"__score": "min", "*": "count"})
    assert twice.where("`count(1)` % 2 <> 0").count() == 0
