"""Base rules against plain counts; divergence on made-up languages."""

import random

import brute
from aqspark.llm import quality

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_columns(make, corpus):
    rows = quality.score(make(corpus)).collect()
    got = sorted((tuple(r[c] for c in ("_id" if False else "doc_id", *BASE)) for r in rows), key=str)
    assert got == sorted(((r[0], *brute.quality_base(r[1])) for r in corpus), key=str)
    assert not any(r.kept and r.base_failed for r in rows)


def prose(rng, lang, n):
    return " ".join(rng.choice(quality.COMMON_WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_junk_goes_and_prose_stays(make):
    rng = random.Random(2)
    rows = [(k, prose(rng, lang, 150), lang, "s") for k, lang in enumerate(["en", "de", "fr", "es"] * 50)]
    junk = [(1000 + k, " ".join(f"x{rng.randint(0, 9)}##{rng.randint(0, 999)}$$" for _ in range(150)), "en", "s") for k in range(3)]
    other = [(2000, junk[0][1], None, "s"), (2001, junk[0][1], "xx", "s")]  # no reference: base rules only
    kept = {r.doc_id: r.kept for r in quality.score(make(rows + junk + other)).collect()}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in junk) and kept[2000] and kept[2001]
    docs = make(rows + junk)
    out = quality.keep(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r[0] for r in rows}


def test_empty(make):
    assert quality.score(make([])).count() == 0 and quality.keep(make([])).count() == 0
