"""Near-duplicates against comparison of all pairs."""

import numpy as np
import pytest

import brute
from aqspark.llm import simhash


def test_golay_is_perfect():
    g, rng = simhash.golay(), np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 2000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 2), replace=False)) for _ in v])
    owner, keys = g.keys(v)
    found = {(o, k) for o, k in zip(owner.tolist(), keys.tolist())}
    assert all((i, int(k)) in found for i, k in enumerate(g.index(v ^ flips)))
    codeword = g.index(v) << 11
    codeword |= g.syndrome(codeword)
    assert np.bitwise_count(codeword ^ v).max() <= 3


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 4000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    (io, ik), (po, pk) = simhash.index_keys(a), simhash.probe_keys(b)
    stored, probed = [set() for _ in a], [set() for _ in a]
    for o, k in zip(io, ik):
        stored[o].add(int(k))
    for o, k in zip(po, pk):
        probed[o].add(int(k))
    assert all(s & p for s, p in zip(stored, probed))


def expected(rows):
    prints = [brute.simhash(r[1]) for r in rows]
    comp = brute.components([r[0] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    return sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comp)), key=str)


@pytest.mark.parametrize("crowded", [128, 1])
def test_equals_all_pairs(make, corpus, crowded):
    got = simhash.near_duplicates(make(corpus), crowded=crowded)
    assert sorted(map(tuple, got.collect()), key=str) == expected(corpus)


@pytest.mark.parametrize("crowded", [8, 1 << 30])
def test_dense_fingerprints(spark, crowded):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(1 << 63), (1 << 63) - 1, 3)
    fp = []
    for c in centre:
        for _ in range(60):
            mask = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))
            fp.append(int(np.array([int(c) & (2**64 - 1) ^ mask], np.uint64).view(np.int64)[0]))
    rows = list(enumerate(fp))
    found = {r.fp: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id bigint, _fp bigint"), crowded=crowded).collect()}
    want = brute.components([i for i, _ in rows], lambda i, j: ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= 3)
    assert [found[f] for f in fp] == want


def test_one_of_each_group_stays(make, corpus):
    docs = make(corpus)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    groups = {}
    for id, _, component in expected(corpus):
        groups.setdefault(component, []).append(id)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(groups, key=str)


def test_components_of_one_id_or_none_stay_apart(make):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 60))
    lone, twice = [text() for _ in range(5)], [text(), text()]
    rows = [(None, t, "en", "s") for t in lone] + [(7, t, "en", "s") for t in twice] + [(None, lone[0], "en", "s"), (8, twice[0], "en", "s")]
    out = simhash.keep_one(make(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("None", t) for t in lone] + [("7", t) for t in twice])


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0
