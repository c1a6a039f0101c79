import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: A table like ``documents`` with a clashing column or two.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, start string, fp string"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(i, t, lang, src, None if t is None else len(t), 7, "x", "y") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, blanks, ties and a long text."""
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(70), text(300)
    rows = [(k, text(rng.randint(1, 160)), "en", f"s{k % 5}") for k in range(60)]
    rows += [(100 + k, text(40) + "\n" + passage + "\n" + text(30), "en", "s0") for k in range(12)]
    rows += [(200 + k, base, "de", "s1") for k in range(15)]
    for k in range(25):
        w = base.split()
        w[rng.randrange(300)] = "changed"
        rows.append((300 + k, " ".join(w), "de", None))
    rows += [(400, None, None, None), (401, "", "en", "s2"), (402, " \t\n ", None, "s2"), (403, "one", "en", ""), (404, "two words", "xx", "s9")]
    rows += [(405, "same line\nsame line\n\nother\x1cline\x85x y z x y z", "en", "s2"), (None, text(90), "en", "s3"), (None, None, "en", "s3")]
    rows += [(406, text(9000), "fr", "s0"), (407, "ab " * 3000, "en", "s4"), (5, rows[5][1], "en", "s0"), (5, rows[5][1], "en", "s0")]
    rows += [(408, "É ÀÉ é 'S tok'en don't. ＡＢ <|endoftext|> ﬁ Å x²y ΑΣ. İstanbul 東京 " * 9, "fr", "é"), (409, "Зима и лето. " * 40, "ru", "s2")]
    return rows
