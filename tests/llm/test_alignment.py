"""Aligned tokens against both tokenizers on whole texts and plain counting."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aqspark.llm import alignment

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
FIRST = Tokenizer.from_file(PATHS[0])
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def first_bytes():
    """Bytes of each entry, from what the tokenizer makes of all bytes."""
    shown = {}
    for b in range(256):
        char = chr(b) if b < 128 else None
        if char is not None:
            shown[FIRST.encode(char, add_special_tokens=False).tokens[0]] = b
    for point in [*range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]:
        if not 0xD800 <= point < 0xE000:
            raw = chr(point).encode()
            for stand_in, b in zip("".join(FIRST.encode(chr(point), add_special_tokens=False).tokens), raw):
                shown[stand_in] = b
    return shown


STAND_IN = first_bytes()


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def plain_align(text):
    """(groups of ids) of a whole text; None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    a_parts = [bytes(STAND_IN[c] for c in FIRST.id_to_token(i)) for i in a]
    b_parts = [bytes([int(p[3:5], 16)]) if SECOND.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, SECOND.id_to_piece(i)) for i in b)]
    if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
        return None
    a_ends, b_ends = ends(a_parts), ends(b_parts)
    cuts = sorted(set(a_ends) & set(b_ends))
    groups, i, j = [], 0, 0
    for cut in cuts:
        i2, j2 = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return groups


def plain_rows(texts):
    found = [plain_align(t) for t in texts]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in found]
    counts, best = Counter(p for c in links for p in c), defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for g, c in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()),
                    sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()),
                    sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def texts(corpus):
    odd = ["", None, " ", "   ", "a ", " a", "a  b", "a\n b", "a\n  b", "a \n b\t c ", "\n", "x   y z", "don't we'll 'S  's", "▁", "a▁b", "<s> </s> <|endoftext|> <0x0A>", "a\x00b",
           "=" * 500, "ab" * 700, "日本語 テキスト 🙂🙂‍↔️ é é", "　x   y", "1234567 89.10 x²y", " " * 90 + "z", "ﬁ ﬃ İ ß", "\x1c \x1d a\x1c b"]
    return odd + [r[1] for r in corpus if r[1] is None or len(r[1]) < 4000]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'sé1 .▁ 　\r"), st.characters(exclude_categories=["Cs"])), max_size=25))
def test_units_equal_whole_texts(text):
    found = alignment.Slice([text], PATHS)
    want = plain_align(text)
    if want is None:
        assert len(found.codes) == 0 and not found.numbers.any()
    else:
        assert bytes(found.groups()[0]).decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)


@pytest.mark.parametrize("shard,fan,chars", [(1 << 20, 64, 1 << 23), (200, 2, 2000)])
def test_equals_plain(spark, texts, monkeypatch, shard, fan, chars):
    for name, value in (("SHARD_PAIRS", shard), ("FAN", fan), ("SLICE_CHARS", chars)):
        monkeypatch.setattr(alignment, name, value)
    schema = "doc_id int, text string, n_a string, shard int, slice string, row int, pairs string, id int, part int"
    docs = spark.createDataFrame([(k, t, "x", 1, "y", 2, "z", 3, 4) for k, t in enumerate(texts)], schema).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in alignment.align(docs, *PATHS).collect()}
    assert [got[k] for k in range(len(texts))] == plain_rows(texts)


def test_equal_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, "some text"), (1, "other text"), (1, None)], "doc_id int, text string")
    rows = sorted(tuple(r)[1:] for r in alignment.align(docs, *PATHS).collect())
    assert rows == sorted(plain_rows(["some text", "some text", "other text", None]))
    shown = {r.groups for r in alignment.align(docs, *PATHS, digest=False).collect()}
    assert "" in shown and all("|" in g for g in shown - {""})
    assert alignment.align(docs.limit(0), *PATHS).count() == 0
    assert [r.n_a for r in alignment.align(docs.where("text is null"), *PATHS).collect()] == [0]


def test_perfect_hash():
    rng = random.Random(2)
    keys = np.array(sorted({rng.randrange(1 << 31) for _ in range(20_000)}), np.int64)
    built = alignment.PerfectHash.build(keys)
    again = alignment.PerfectHash.read(built.sizes(), built.bits(), built.keys.astype("<i8").tobytes())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    assert sum(len(b) for b in again.levels) < 8 * len(keys)
    with pytest.raises(ValueError):
        again.index(np.array([keys[-1] + 1]))
    assert len(alignment.PerfectHash.build(keys[:0]).index(keys[:0])) == 0
