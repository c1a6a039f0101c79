"""Extra columns come back untouched, whatever they are called."""

import re
from pathlib import Path

import pytest

from aqspark.llm import mixing, quality, secrets, simhash

NAMES = sorted(
    {n for f in ("quality", "simhash", "secrets", "mixing", "common") for n in re.findall(r'"(_[a-z]\w*)"', (Path(quality.__file__).parent / f"{f}.py").read_text())}
    | {"_key1", "_key2", "id", "fp", "size", "digest", "component", "node", "shard", "block", "start", "root", "first_id", "piece_start", "a.b", "u", "v", "_n1"}
)


@pytest.mark.parametrize("stage", [quality.keep, simhash.keep_one, secrets.redact, mixing.mixed_documents])
def test_stage_keeps_extra_columns(make, corpus, stage):
    docs = make(corpus).select("doc_id", "text", "lang", "source", "n_chars")
    extra = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in NAMES))
    out, plain = stage(extra), stage(docs)
    assert out.columns == extra.columns
    rows = out.collect()
    for r in rows:
        for n in NAMES:
            assert r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}"), n
    key = lambda r: str((r["doc_id"], r["text"]))
    if stage is not mixing.mixed_documents:
        assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
