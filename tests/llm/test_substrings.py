"""Repeated windows against all windows, and the sketch's one-sided error."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import brute
from aqspark.llm import substrings


def test_anchors_follow_from_windows():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    h = substrings.run_hashes(words, substrings.GRAM)
    want = [h[k : k + substrings.WINDOW - substrings.GRAM + 1].min() for k in range(300 - substrings.WINDOW + 1)]
    assert substrings.anchors(words).tolist() == [int(x) for x in want]
    assert (substrings.run_hashes(words[100:200], 50) == substrings.run_hashes(words, 50)[100:151]).all()
    assert len(substrings.anchors(words[:49])) == 0 and len(substrings.anchors(words[:50])) == 1


@pytest.mark.parametrize("width", [None, 1 << 20, 8192])
def test_equals_all_windows(make, corpus, monkeypatch, width):
    if width == 8192:  # crowded counters: more windows pass the prefilter, none is lost
        monkeypatch.setattr(substrings, "SLICE", 1024)
    out = substrings.remove_repeats(make(corpus).repartition(3), width=width)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(brute.repeats_removed([(r[0], r[1]) for r in corpus]), key=str)


def test_rows_of_one_id_are_judged_by_their_own_text(make):
    shared, own, other = (" ".join(f"{c}{k}" for k in range(90)) for c in "abc")
    rows = [(1, shared, "en", "s"), (2, own + " " + shared, "en", "s"), (2, other + " " + own, "en", "s"), (2, "short", "en", "s"), (2, None, "en", "s")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(make(rows)).collect()), key=str)
    assert got == sorted(brute.repeats_removed([(r[0], r[1]) for r in rows]), key=str)


def test_empty(make):
    assert substrings.remove_repeats(make([])).count() == 0


def test_counters_stop_at_two():
    rng = np.random.default_rng(0)
    counters, want = substrings.Counters(4096), np.zeros(4096, int)
    for _ in range(50):
        cells = np.unique(rng.integers(0, 4096, 300))
        counters.add(cells)
        want[cells] += 1
    assert (counters.part(1024, 2048) == np.minimum(want, 2)[1024:3072]).all()


def test_runs_and_second_hashes_on_demand():
    assert substrings.runs(np.array([5, 5, 7, 5, 5], np.uint64)).tolist() == [0, 2, 3] and len(substrings.runs(np.empty(0, np.uint64))) == 0
    texts = ["a b a", "", "c a"]
    found = list(substrings.WordHashes().texts(pa.array([*texts, None])))
    assert [f.tolist() for f, _ in found] == [[xxhash.xxh64_intdigest(w, 1) for w in t.split()] for t in [*texts, ""]]
    assert [second().tolist() for _, second in found] == [[xxhash.xxh64_intdigest(w, 2) for w in t.split()] for t in [*texts, ""]]
