"""Token ids and files: the tokenizer's own ids, round trips, odd rows."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequery.llm import token_file, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_word_encoder_gives_the_tokenizers_ids(tokenizer, texts):
    coder = words.encoder(words.vocabulary_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["It's Word, a.b. c... d?! É. ΟΔΟΣ ²x İ <|endoftext|>. x_y."]
    for got, text in zip(coder.encode(texts), texts, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_forgets(tokenizer):
    coder = words.WordEncoder(words.vocabulary_path(), cap=50)
    for k in range(30):
        text = " ".join(f"w{k}x{i} common" for i in range(20))
        assert next(coder.encode([text])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_blocks_round_trip(values):
    ranks = np.array(values, np.uint32)
    assert np.array_equal(token_file.decode_block(*token_file.encode_block(ranks), len(ranks)), ranks)


def test_token_file_round_trip(monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 8)
    given_docs = [(None, [7]), (3, []), (3, list(range(30))), (9, [5, 5, 400000])]
    out = io.BytesIO()
    writer = token_file.TokenFileWriter(out, np.unique(np.array([x for _, d in given_docs for x in d], np.uint32))[::-1].copy())
    for doc_id, ids in given_docs:
        writer.add(doc_id, np.array(ids, np.uint32))
    writer.close()
    out.seek(0)
    assert [(d, ids.tolist()) for d, ids in token_file.read_token_file(out)] == given_docs


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, ids_of, which):
    df = request.getfixturevalue(which)
    got = token_file.read_token_files(token_file.write_token_files(df)).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(ids_of(r.text, 2).tobytes())) for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_empty_table(docs):
    assert token_file.read_token_files(token_file.write_token_files(docs.limit(0))).count() == 0
