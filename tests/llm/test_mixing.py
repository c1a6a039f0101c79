"""Mix targets, permutations and words taken."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from aqspark.llm import mixing


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 1000, 3], [0, 5], [7], [100] * 20, [5, 0, 0, 9000, 1]])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(brute.mix_targets(sizes) if sum(sizes) else [0.0] * len(sizes))


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        source = mixing.Source(3, "s", 0, 0.0, n, n)
        keys = F.array(*(F.lit(k).cast("long") for k in mixing.round_keys(source, 1)))
        out = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys)).collect()]
        assert sorted(out) == list(range(n))
        assert n < 64 or sum(a == b for a, b in zip(out, range(n))) < n / 8


def test_totals(make, corpus):
    rows = mixing.document_totals(mixing.mix(make(corpus))).collect()
    again = mixing.document_totals(mixing.mix(make(corpus).repartition(5))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=str) == sorted(((i, len(brute.words(t))) for i, t, *_ in corpus), key=str)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(brute.words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, brute.mix_targets([sizes[n] for n in names])))
    found = mixing.mix(make(corpus))
    taken, target = defaultdict(int), {}
    for r in found.pieces.collect():
        taken[found.sources[r["_at"]].name] += r.piece_length
    for s in found.sources:
        assert s.target == pytest.approx(want[s.name]) and abs(taken[s.name] - s.target) <= mixing.BLOCK


def test_documents(make, corpus):
    docs = make(corpus)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.document_totals(mixing.mix(docs)).collect():
        taken[r.doc_id] += r.taken
    rows = out.collect()
    # the two read documents in another order, so compare sums
    got = sum(len(brute.words(r.text)) for r in rows)
    assert abs(got - sum(taken.values())) <= 2 * mixing.BLOCK * 9
    known = defaultdict(set)
    for id, t, *_ in corpus:
        known[id] |= set(brute.words(t))
    assert all(set(brute.words(r.text)) <= known[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_empty(make):
    assert mixing.document_totals(mixing.mix(make([]))).count() == 0 and mixing.mixed_documents(make([])).count() == 0
    blank = make([(1, None, None, None), (2, "", None, "s")])
    assert [r.taken for r in mixing.document_totals(mixing.mix(blank)).collect()] == [0, 0]
