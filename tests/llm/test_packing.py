"""Token ids and sequences against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aqspark.llm import packing
from aqspark.llm.tokens import text_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_tokens_of_words_are_tokens_of_texts(corpus):
    odd = ["Καλημέρα ΟΔΟΣ ΟΔΟΣ. ΟΔΟΣ'", "don't 's x's! we'll", "á é. Å ｆｕｌｌ", "½x ٣٤ x² ªº", "한국어 한글.", " x y　z", "<|startoftext|>a<|endoftext|>.", "ǅ ǆ Ⅷ ẞ ß. İ. ﬀ"]
    texts = [r[1] for r in corpus] + odd
    got = [list(x) for x in text_tokens(pa.array(texts), PATH)]
    assert got == [ids(t) for t in texts]


@pytest.mark.parametrize("window,open_windows,min_cut", [(2048, 16, 32), (64, 2, 4)])
def test_pieces(make, corpus, window, open_windows, min_cut):
    out = packing.pack(make(corpus).repartition(3), PATH, ids=True, window=window, open_windows=open_windows, min_cut=min_cut).collect()
    want = defaultdict(list)
    for r in corpus:
        want[r[0]].append(ids(r[1]) + [1])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        raw = np.frombuffer(bytes(r.ids), "<u4")
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(raw) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.doc_tokens, r.start, raw.tolist()))
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= window
    full = sum(n for v in sequences.values() for _, n in v)
    assert full >= 0.97 * window * (len(sequences) - 1)
    for id, texts in want.items():
        if len(texts) == 1 or len(set(map(tuple, texts))) == 1:
            pieces, at = sorted(got[id]), defaultdict(list)
            for total, start, raw in pieces:
                at[start].append(raw)
            if len(texts) == 1:
                assert sum((p[2] for p in pieces), []) == texts[0] and {p[0] for p in pieces} == {len(texts[0])}
            else:
                assert sum(len(p[2]) for p in pieces) == sum(map(len, texts))


def test_empty(make):
    assert packing.pack(make([]), PATH).count() == 0
