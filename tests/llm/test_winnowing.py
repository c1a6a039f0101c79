"""Benchmark passages in documents against all windows."""

import random
import re

import pytest

from aqspark.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(texts, items):
    spans = []
    for id, text in items:
        w = plain_words(text)
        n = min(len(w), 10)
        spans += [(id, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for id, span in spans:
            n = len(span)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == span:
                    hit |= set(range(k, k + n))
                    found |= {str(id)} - {"None"}
        out.append((len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return out


@pytest.fixture(scope="module")
def planted(corpus):
    rng = random.Random(8)
    word = lambda: rng.choice("ab Ä é ı K zug x9 İstanbul 東京 the of".split())
    text = lambda n, sep=" ": sep.join(word() for _ in range(n))
    items = [(k, text(rng.randint(9, 40))) for k in range(25)] + [(100 + k, text(k)) for k in range(10)]
    items += [(200, None), (201, ""), (202, "?!"), (203, items[3][1]), (None, text(12)), (204, "a " * 30), (5, text(15)), ("x,y", "one odd id")]
    items = [(None if k is None else str(k), t) for k, t in items]
    pick = lambda: rng.choice(items)[1] or ""
    texts = [text(rng.randint(0, 60)) + "; " + pick().upper().replace(" ", "-") + " -- " + text(rng.randint(0, 30)) for _ in range(120)]
    texts += [items[2][1]] * 30 + [t for _, t, *_ in corpus if t is None or len(t) < 3000] + ["a " * 500, "AA\x00bb\x7fcc", "É é"]
    return texts, items


def test_equals_all_windows(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS n_hit", "2 AS _key", "3 AS _words", "4 AS item_id").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "9 AS _len", "8 AS _text", "7 AS doc_id")
    got = {r[0]: tuple(r)[1:] for r in winnowing.scan(docs, bench).collect()}
    want = plain_scan(texts, items)
    assert len(got) == len(texts) and [got[k] for k in range(len(texts))] == want
    assert sum(w[4] for w in want) > 100 and not all(w[4] for w in want)


def test_empty_tables(spark, planted):
    docs = spark.createDataFrame([(None, "one odd id here"), (1, None), (1, "x")], "doc_id int, text string")
    items = spark.createDataFrame(planted[1], "item_id string, text string")
    rows = winnowing.scan(docs, items).collect()
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in rows) == [(0, 0, ""), (1, 0, ""), (4, 3, "x,y")]
    assert winnowing.scan(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in winnowing.scan(docs, items.limit(0)).collect()] == [0, 0, 0]
