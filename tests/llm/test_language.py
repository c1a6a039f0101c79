"""Language labels: held-out accuracy, mixed texts, paths against search."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from aqspark.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_paths_are_best():
    rng = np.random.default_rng(1)
    sizes = [0, 5, 1, 7, 0, 3]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, (bounds[-1], 3))
    labels = language.best_paths(scores, bounds, 2.0)
    value = lambda s, p: sum(s[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            s = scores[a:b]
            best = max(value(s, p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(s, labels[a:b].tolist()) - best) < 1e-9


def test_mixed_and_scripts(make):
    en, de, ru = "the cat and the dog were in the house of that man ", "der hund und die katze waren nicht in dem haus ", "кошка и собака были в доме "
    train = make([(k, t * 20, lang, "s") for k, (t, lang) in enumerate(((en, "en"), (de, "de"), (ru, "ru")))] + [(7, None, "en", "s"), (8, "x", None, "s")])
    model = language.train(train)
    assert model.languages == ["de", "en", "ru"]
    docs = make([(1, en * 3 + de * 2, None, None), (2, ru, None, None), (3, "123 ... !", None, None), (4, None, None, None), (5, "", None, None), (6, "東京", None, None)])
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [s.lang for s in out[1].spans] == ["en", "de"] and out[1].lang_pred == "en" and 0.5 < out[1].score < 0.7
    assert out[1].spans[0]["last"] + 1 == out[1].spans[1]["first"]
    assert out[2].lang_pred == "ru" and out[2].score == 1.0
    assert [(out[k].lang_pred, out[k].score) for k in (3, 4, 5)] == [("und", 0.0)] * 3
    assert out[6].lang_pred == "de"  # no language uses the script: the first one


def test_numerals_are_no_letters(make):
    model = language.train(make([(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s")]))
    texts = ["½ ²", "Ⅷ", "① ②", "_ 12 ٣", "́ ̈", "ª"]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(make([(k, t, None, None) for k, t in enumerate(texts)]), model).collect()}
    assert [out[k] for k in range(5)] == [("und", 0.0)] * 5 and out[5][0] != "und"


def test_nothing_learned(make):
    model = language.train(make([(1, None, None, None)]))
    assert [r.lang_pred for r in language.identify(make([(1, "some text", "en", "s")]), model).collect()] == ["und"]
    assert language.identify(make([]), model).count() == 0
