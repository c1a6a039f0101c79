"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from aqspark.llm import spelling


def plain_words(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (form, n, len(found), None if form is None else counts[form])
    rows = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, n, k, m)
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 7))) for _ in range(300)]
    words += ["abcdefgh", "abcdefgg", "abcdefg", "abcdeg", "hgfedcba", "a" * 300, "a" * 301, "b" * 7, "÷×ùúûü", "ÀÁÂÃÄÅ", "àÁÂÃÄÅ"]
    bag = [w for w in words for _ in range(rng.choice([1, 5, 5, 6, 30, 160]))]
    rng.shuffle(bag)
    rows = [(k if k % 9 else None, " ".join(bag[i : i + 50]).title() if k % 5 == 0 else ", ".join(bag[i : i + 50])) for k, i in enumerate(range(0, len(bag), 50))]
    return rows + [(1, None), (2, ""), (3, "short 123"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("leaf,points", [(40_000, 24), (10, 2)])
def test_equals_all_pairs(spark, rows, monkeypatch, leaf, points):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    monkeypatch.setattr(spelling, "POINTS", points)
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS word", "2 AS _run", "3 AS n").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(docs).collect()}
    want = plain_groups(plain_words(rows))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] not in (None, v[1]) for v in want.values())


def test_trees_reach_all_neighbours():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcde") for _ in range(7)) for _ in range(3000)})
    tree = spelling.Tree.fit(spelling.letter_counts(words), 20)
    assert tree.leaves > 10
    home = dict(zip(*map(list, tree.reach(spelling.letter_counts(words), 0, 0))))
    assert sorted(home) == list(range(len(words)))
    row, leaf = tree.reach(spelling.letter_counts(words), 1, 1)
    reached = set(zip(row.tolist(), leaf.tolist()))
    assert len(reached) < 0.9 * len(words) * tree.leaves
    for k, w in enumerate(words[:200]):
        assert all((k, home[j]) in reached for j, x in enumerate(words) if near(w, x))


def test_large_anagram_class(spark):
    rng = random.Random(1)
    words = list({"".join(rng.sample("a" * 10 + "b" * 10, 20)) for _ in range(20_000)})
    found = list(spelling.variants(words, [words[0][:-1] + ("b" if words[0][-1] == "a" else "a"), words[0][1:]], 20))
    assert {words[p] for _, p in found} >= {words[0]}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert spelling.variant_groups(docs).count() == 0
