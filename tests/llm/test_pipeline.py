"""The pipeline against a plain version that follows every document."""

import numpy as np
import pytest
from conftest import DATA

from pagequery.llm import mixing, order_minhash, secret_forest, weak_quality, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_document_is_followed(spark, ids_of, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = weak_quality.fit_quality(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    good = {i for i, r in rows.items() if (r.text or "").strip() and weak_quality.score(model.weights, weak_quality.hashed_features(r.text)) >= 0.35}
    told = {i: order_minhash.WordHashes()(order_minhash._WORD.findall(rows[i].text.lower())).astype("<u4") for i in good}
    label = {i: i for i in good}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(good):
        for j in sorted(good):
            if j < i and order_minhash.similar(told[i], told[j], 0.8):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    first = {i for i in good if root(i) == i}
    forest, known = secret_forest.fit_forest(), secret_forest.dictionary(words.vocabulary_path())

    def redacted(r):
        text = r.text
        for c, p in reversed(secret_forest.scan(text, r.source, forest, known)):
            if p >= 0.5:
                text = text[: c.start] + "[SECRET]" + text[c.end :]
        return text

    clean = {i: redacted(rows[i]) for i in first}
    seen = {}  # what each stage gets, which is what the one before it left

    def watched(name, stage):
        def run(spark, df, sf_dir):
            seen[name] = df.columns, df.collect()
            return stage(spark, df, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(name, stage)) for name, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, DATA).collect()
    assert all(columns == docs.columns for columns, _ in seen.values())
    ids = {name: sorted(r.doc_id for r in rows) for name, (_, rows) in seen.items()}
    assert ids["minhash_near_dedup"] == sorted(good) and ids["secret_scans"] == sorted(first) and ids["source_mixing"] == sorted(first)
    texts = {r.doc_id: r for r in seen["source_mixing"][1]}
    assert {i: r.text for i, r in texts.items()} == clean and all(r.n_chars == len(r.text) for i, r in texts.items() if r.text != rows[i].text)
    mixed = {r.doc_id for r in seen["best_fit_packing"][1]}
    assert mixed == {r.doc_id for r in mixing.mix_documents(spark.createDataFrame(seen["source_mixing"][1], docs.schema), columns=["doc_id"]).collect()}
    assert {r.doc_id for r in out} == mixed and 0 < len(mixed) < len(first)
    whole = {i: ids_of(clean[i], 1) for i in mixed}
    import zlib

    used = {}
    for r in out:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 4096 * r.piece and zlib.crc32(part.tobytes()) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(map(len, whole.values()))
    for places in used.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 4096


def test_odd_rows_pass_every_stage(spark, odd):
    kept = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() >= 0


def test_an_empty_table_passes_every_stage(spark, odd):
    kept = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DATA)
        assert kept.count() == 0, name
