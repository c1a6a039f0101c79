"""Block-wise series helpers against pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aqspark.operators.quantiles import exact_quantiles
from aqspark.operators.series import ewm_mean, running, series_window, with_position


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # one series holds most rows, and half of them at one instant
    pdf = pd.DataFrame({
        "city": np.where(rng.random(n) < 0.7, "A", np.where(rng.random(n) < 0.5, "B", "C")),
        "t": np.where(rng.random(n) < 0.5, 500, np.arange(n)),
        "id": np.arange(n),
        "x": np.where(rng.random(n) < 0.1, np.nan, rng.random(n).round(2)),
    })
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "city string, t long, id long, x double")
    return pdf.sort_values(["city", "t", "id"]).reset_index(drop=True), df.repartition(6)


def aligned(df, pdf, column):
    got = df.toPandas().sort_values(["city", "t", "id"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    return got[column].astype(float).to_numpy()


def test_position(data):
    pdf, df = data
    out = with_position(df, ["city"], ["t", "id"])
    np.testing.assert_array_equal(aligned(out, pdf, "_pos"), pdf.groupby("city").cumcount())
    np.testing.assert_array_equal(aligned(out, pdf, "_n"), pdf.groupby("city").x.transform("size"))


def test_position_with_null_key_and_no_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("A", 3)], "city string, t long")
    rows = {(r.city, r.t): (r._pos, r._n) for r in with_position(df, ["city"], ["t"]).collect()}
    assert rows == {(None, 1): (0, 2), (None, 2): (1, 2), ("A", 3): (0, 1)}
    assert sorted(r._pos for r in with_position(df, [], ["t"]).collect()) == [0, 1, 2]


def test_frames_cross_blocks(data):
    pdf, df = data
    placed = with_position(df, ["city"], ["t", "id"])
    out = series_window(
        placed, ["city"],
        lambda w: {"lag": F.lag("x", 7).over(w), "mean": F.avg("x").over(w.rowsBetween(-9, 0)), "lead": F.lead("x", 2).over(w)},
        before=9, after=2, min_block=16,
    )
    g = pdf.groupby("city").x
    np.testing.assert_allclose(aligned(out, pdf, "lag"), g.shift(7))
    np.testing.assert_allclose(aligned(out, pdf, "lead"), g.shift(-2))
    np.testing.assert_allclose(aligned(out, pdf, "mean"), g.transform(lambda s: s.rolling(10, min_periods=1).mean()))


def test_running(data):
    pdf, df = data
    placed = with_position(df, ["city"], ["t", "id"])
    out = running(placed, ["city"], sums={"s": F.col("x")}, lasts={"l": F.col("x")}, nexts={"n": F.col("x")}, min_block=16)
    g = pdf.groupby("city").x
    np.testing.assert_allclose(aligned(out, pdf, "s"), g.transform(lambda s: s.fillna(0).cumsum()))
    np.testing.assert_allclose(aligned(out, pdf, "l"), g.ffill())
    np.testing.assert_allclose(aligned(out, pdf, "n"), g.bfill())


def test_ewm_with_nulls(data):
    pdf, df = data
    out = ewm_mean(with_position(df, ["city"], ["t", "id"]), ["city"], "x", {"e3": 3, "e168": 168})
    for name, span in (("e3", 3), ("e168", 168)):
        want = pdf.groupby("city").x.transform(lambda s, span=span: s.ewm(span=span).mean())
        np.testing.assert_allclose(aligned(out, pdf, name), want, rtol=1e-9)


def test_exact_quantiles(data):
    pdf, df = data
    out = exact_quantiles(df, ["city"], "x", {"q1": 0.25, "q2": 0.5, "q95": 0.95}).toPandas().set_index("city").sort_index()
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q95", 0.95)):
        np.testing.assert_allclose(out[name], pdf.groupby("city").x.quantile(p))
    assert exact_quantiles(df, [], "x", {"m": 0.5}).first().m == pytest.approx(pdf.x.median())
