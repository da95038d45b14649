"""Best-fit packing: every id once, the bound at work, sequences near the least number."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequery.llm import packing


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, ids_of, which):
    df = request.getfixturevalue(which)
    rows = packing.pack_documents(df).collect()
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0] + [p[1] for p in places])[:-1].tolist() and sum(p[1] for p in places) <= 4096
    sizes = [len(ids_of(r.text, 1)) for r in df.select("text").collect()]
    assert sum(r.length for r in rows) == sum(sizes) and len(rows) == sum(-(-n // 4096) for n in sizes)
    assert len(by_sequence) <= 1.02 * sum(sizes) / 4096 + 1


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 5))
def test_best_fit_takes_the_fullest_bin_that_fits(lengths, open_bins):
    bins, free, live = packing.BestFit(64, open_bins), {}, []
    for n in lengths:
        where, offset = bins.place(n)
        fits = [b for b in live if free[b] >= n]
        if fits:
            assert free[where] == min(free[b] for b in fits)
        else:
            if len(live) >= open_bins:
                live.remove(min((b for b in live), key=lambda b: free[b])) if len({free[b] for b in live}) == len(live) else live.remove(max((b for b in live if free[b] == min(free[x] for x in live)), key=live.index))
            free[where] = 64
            live.append(where)
        assert offset == 64 - free[where]
        live.remove(where)
        free[where] -= n
        if free[where]:
            live.append(where)


def test_the_fullest_bin_closes_first_on_documents(docs, monkeypatch):
    """With the operator's own number of open bins some close, and sequences stay within 2 % of the bound."""
    lengths = [r.length for r in packing.pieces_of(docs, packing.vocabulary_path(), 1, 4096, False).where("length < 4096").orderBy("doc_id").collect()] * 8
    bins, closed = packing.BestFit(4096, 64), []
    take = bins._take
    monkeypatch.setattr(bins, "_take", lambda space: closed.append((space, (bins.spaces & -bins.spaces).bit_length() - 1, bins.n_open)) or take(space))
    for n in lengths:
        before, opened = len(closed), bins.opened
        bins.place(n)
        if bins.opened > opened and len(closed) > before:
            assert closed[-1][0] == closed[-1][1] and closed[-1][2] == 64  # the least free space of 64 bins
    assert any(n_open == 64 for *_, n_open in closed)
    assert bins.opened <= 1.02 * sum(lengths) / 4096 + 1


def test_groups_are_bounded_by_rows(spark):
    short = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack_documents(short, group_rows=5_000, with_ids=False).select("sequence_id", "offset").collect()
    assert len(rows) == 30_000 and len({r.sequence_id >> 32 for r in rows}) == 6
    assert len({(r.sequence_id, r.offset) for r in rows}) == 30_000 and max(r.offset for r in rows) < 4096


def test_empty_and_clashing(docs, clashing):
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(clashing, with_ids=False).count() == 20
