import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import quantiles as qt
from loomtext.operators import report as rp

SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def classes():
    draw = np.random.default_rng(7)
    return {
        "normal": draw.normal(size=5000),
        "ties": np.repeat([3.0, 5.0], [3000, 2000]),
        "few between many": np.concatenate([np.zeros(2000), np.arange(1, 8), np.full(2000, 9.0)]),
        "skewed": np.exp(draw.normal(size=4001) * 40),
        "one": np.array([4.5]),
        "two": np.array([-1.0, 2.0]),
    }


@pytest.mark.parametrize("few", [50, 200, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    """Also where parts are narrowed in several steps, and where a sketch is coarse."""
    monkeypatch.setattr(qt, "FEW", few)
    monkeypatch.setattr(qt, "SKETCH", 64 if few == 200 else 4096)
    own = classes()
    rows = [(k, float(v)) for k, vs in own.items() for v in vs] + [("one", None), ("two", float("nan")), (None, 1.0), ("none", None)]
    got = {r.g: r for r in qt.exact_quantiles(spark.createDataFrame(rows, "g string, _v double"), ["g"], SHARES).collect()}
    assert set(got) == set(own)
    for k, vs in own.items():
        assert got[k].n_rows == len(vs) and np.allclose(got[k].quantiles, np.quantile(vs, SHARES), rtol=1e-12, atol=0)


def test_large_tables_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(qt, "MOST_SENT", 0)
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("_v"))
    got = {r.g: r.quantiles for r in qt.exact_quantiles(rows, ["g"], [0.5]).collect()}
    assert got == {0: [1498.5], 1: [1499.5], 2: [1500.5]}


def test_box_plots_of_no_rows_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert rp.box_plot_stats(empty, F.col("v"), ["g"]).count() == 0 == rp.fliers(empty, F.col("v"), ["g"]).count()
    same = spark.createDataFrame([("a", 2.0)] * 9, "g string, v double")
    row = rp.box_plot_stats(same, F.col("v"), ["g"]).first()
    assert (row.q1, row.whisker_low, row.whisker_high, row.n_fliers) == (2, 2, 2, 0) and rp.fliers(same, F.col("v"), ["g"]).isEmpty()


def test_fliers(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100, -80)] + [("b", 1.0)], "g string, v double")
    assert sorted(tuple(r) for r in rp.fliers(rows, F.col("v"), ["g"]).collect()) == [("a", -80.0), ("a", 100.0)]
