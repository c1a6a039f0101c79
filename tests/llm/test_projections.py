"""Embedding links against all pairs."""

import math

import numpy as np
import pytest

import brute
from aqspark.llm import projections


def test_needed_count():
    p = math.erf(projections.WINDOW / math.sqrt(2))
    tail = sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(projections.needed(), 33))
    assert tail >= projections.RECALL


def planted():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    rows = [list(map(float, v)) for v in base]
    for k in range(60):  # around one vector, at many angles
        rows.append(list(map(float, base[0] + rng.standard_normal(16) * rng.uniform(0.02, 0.35))))
    rows += [rows[3]] * 20 + [[2 * x for x in rows[4]]] + [rows[5]] * 2
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0], [3e-200] * 16, [1e200] * 16]
    return [(k * 3, v) for k, v in enumerate(rows)] + [(None, rows[6]), (7 * 3, rows[7])]


@pytest.mark.parametrize("cell,stored,probe", [(512, 1024, 2048), (16, 8, 16)])
def test_equals_all_pairs(spark, monkeypatch, cell, stored, probe):
    for name, value in (("CELL", cell), ("STORED_BLOCK", stored), ("PROBE_BLOCK", probe)):
        monkeypatch.setattr(projections, name, value)
    rows = planted()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, node int, copies string")
    n, linked = brute.cosine_links([v for _, v in rows])
    comp = brute.components([i for i, _ in rows], linked)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in projections.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, k, c, i == c) for (i, _), k, c in zip(rows, n, comp)), key=str)


def test_empty(spark):
    assert projections.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
