"""Rows that a step multiplies are never broadcast: Spark sizes them as if it had not."""

import numpy as np
import pytest

from aqspark.llm import mixing, simhash


def broadcast(df) -> list[str]:
    """The plan under each broadcast of ``df``."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((i for i in range(k + 1, len(lines)) if depth(lines[i]) <= depth(line)), len(lines))
            found.append("\n".join(lines[k:end]))
    return found


@pytest.mark.parametrize("crowded", [128, 1])
def test_keys_of_fingerprints(spark, crowded):
    rng = np.random.default_rng(6)
    fp = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
    near = (fp.view(np.uint64) ^ np.uint64(1)).view(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in [*fp, *near]], "fp bigint"), crowded)
    assert edges.distinct().count() >= 200
    assert [p for p in broadcast(edges) if "MapInArrow" in p] == []
    # nor the other side of such a join, which is stored but has many rows for a fingerprint
    joins = [line for line in edges._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_blocks_of_documents(make, corpus):
    pieces = mixing.mix(make(corpus)).pieces
    assert pieces.count() > 0
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and [p for p in broadcast(pieces) if "Generate explode" in p or "shard" in p] == []
