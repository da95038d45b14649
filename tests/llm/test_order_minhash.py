"""Order MinHash near-duplicates against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequery.llm import order_minhash


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30), st.integers(0, 30))
def test_banded_distance(a, b, most):
    assert order_minhash.bounded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(_edits(a, b), most + 1)


def test_a_repeated_kmer_leaves_the_others_as_they_are():
    words = np.arange(40, dtype=np.uint64)
    plain = order_minhash.labelled_kmers(words, 5)
    again = order_minhash.labelled_kmers(np.concatenate([words, words[:6]]), 5)
    assert (again[:36] == plain).all() and not set(again[40:].tolist()) & set(plain.tolist())


def test_near_duplicates_against_brute_force(docs):
    texts = {r.doc_id: order_minhash.WordHashes()(order_minhash._WORD.findall(r.text.lower())).astype("<u4") for r in docs.select("doc_id", "text").collect()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and order_minhash.similar(texts[i], texts[j], 0.8):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in texts}
    kept = order_minhash.keep_one_of_each(docs)
    assert kept.count() == len(set(got.values())) and kept.columns == docs.columns


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = order_minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r.doc_id, r.kept) for r in rows if r.doc_id == 2) == [(2, False), (2, True)]  # equal empty texts
    assert [r.kept for r in rows if r.doc_id == 1] == [True]
    base = " ".join(f"w{i}" for i in range(200))
    near = spark.createDataFrame([(7, base), (3, base.replace("w50 ", "x ").replace("w120 ", "")), (9, base.upper()), (1, "quite another text " * 9)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(near).collect()} == {7: 3, 3: 3, 9: 3, 1: 1}


def test_near_duplicates_with_scattered_edits(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(400):
        n = (5, 10, 20, 60, 70, 100, 200, 400)[i % 8]
        a = [f"w{x}" for x in r.integers(0, 1_000_000, n)]
        b = list(a)
        for at in r.choice(n, n // 5, replace=False):
            b[at] = f"x{i}y{at}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(400))
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 396


def test_hot_buckets_are_not_gathered(docs):
    """With a low limit many buckets count as hot; the classes are the same."""
    told = lambda **more: {r.doc_id: (r.class_id, r.class_rows, r.kept) for r in order_minhash.near_duplicates(docs, **more).collect()}
    assert told(hot_rows=64) == told()


def test_blocks_give_every_pair_across_components(monkeypatch):
    """The pairs of a bucket in blocks, against all pairs."""
    r = np.random.default_rng(4)
    n = 60
    label = r.integers(0, 6, n)
    inside = label == 0
    texts = [r.integers(0, 50, 40).astype(np.uint64) for _ in range(n)]
    bits = np.stack([order_minhash.word_bits(t).view(np.uint64) for t in texts])
    keys = [np.array([7]) for _ in range(n)]
    rows = []
    large, small = 2, 3
    for i in range(n):
        own = i % (large if inside[i] else small)
        places = [(0, j, own) for j in range(small)] if inside[i] else [(0, own, j) for j in range(large)] + [(1, min(own, j), max(own, j)) for j in range(small)]
        rows += [(*p, own, i) for p in places]
    rows.sort()
    at = np.array([x[4] for x in rows])
    block = {"key": np.full(len(rows), 7), "kind": np.array([x[0] for x in rows]), "b0": np.array([x[1] for x in rows]), "b1": np.array([x[2] for x in rows]), "own": np.array([x[3] for x in rows])}
    block |= {"inside": inside[at], "label": label[at], "n": np.full(len(rows), 40), "first": np.full(len(rows), 3), "second": np.full(len(rows), 90), "bits": bits[at]}
    got = sorted(tuple(sorted((at[i], at[j]))) for p, q in order_minhash.alike_pairs(block, [keys[x] for x in at], 0.01) for i, j in zip(p, q))
    assert got == [(i, j) for i in range(n) for j in range(i + 1, n) if label[i] != label[j]]


def test_pairs_within_groups():
    sizes = np.array([1, 4, 2, 1, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    want = [(a + i, a + j) for a, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n)]
    assert [(int(i), int(j)) for p, q in order_minhash.pairs_within(starts, sizes, 3) for i, j in zip(p, q)] == want


def test_components(spark):
    from pagequery.llm.components import connected_components

    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(None, 3), (5, 5)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in label if root(x) != x}


def test_empty_and_clashing(docs, clashing):
    assert order_minhash.keep_one_of_each(docs.limit(0)).count() == 0
    out = order_minhash.keep_one_of_each(clashing.unionByName(clashing))
    assert out.columns == clashing.columns and out.count() == order_minhash.near_duplicates(clashing).where("kept").count()


def test_the_largest_component_of_a_bucket_does_not_leave_the_join(spark):
    """Members outside it meet one of its texts; none of its own come out of the join on the bucket."""
    rows = [(1, h, 10, 5, 9, h, 7) for h in range(300)] + [(1, h, 10, 5, 9, h, 8) for h in (300, 301)] + [(1, 400, 100, 5, 9, 400, 9)]
    bucket = spark.createDataFrame(rows, "key long, h long, n int, first short, second short, id long, label long")
    found = order_minhash._against_main(bucket, 0.8)
    told = [(r.a, r.b) for r in found.collect()]
    assert {b for _, b in told} == {300, 301} and len({a for a, _ in told}) == 1 and told[0][0] < 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "NOT (label" in line for line in plan.splitlines())


def test_only_buckets_that_stay_open_are_gone_through_again(spark, monkeypatch):
    """A hot bucket of two components that the second pass joins up leaves no member in a join on the bucket; one that stays open keeps all, with the newer labels."""
    rows = [(1, h, 10, 5, 9, h, 7) for h in range(7, 300)] + [(1, h, 10, 5, 9, h, 400) for h in range(400, 420)] + [(2, h, 10, 5, 9, h, 7) for h in (7, 8)] + [(2, 500, 10, 5, 9, 500, 500)]
    named = order_minhash.stored(spark.createDataFrame(rows, "key long, h long, n int, first short, second short, id long, label long"), "named")
    labels = spark.createDataFrame([(400, 7)] + [(h, 7) for h in [*range(8, 300), *range(401, 420)]], "node long, label long")
    written, stored = {}, order_minhash.stored

    def counting(df, tag, *done):
        out = stored(df, tag, *done)
        written.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "stored", counting)
    parts = order_minhash._parts(named)
    left = sorted((r.key, r.h, r.label) for r in order_minhash._still_open(named, parts, labels).collect())
    assert left == [(2, 7, 7), (2, 8, 7), (2, 500, 500)]
    assert written == {"parts": [4], "several": [1], "open": [3, 3]}
