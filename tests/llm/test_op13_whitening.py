import math

import numpy as np
import pytest

from loomtext.llm.queries import op13_whitening
from loomtext.llm.vectors import sound_vectors
from loomtext.llm.whitening import fit_whitening, whiten

SCHEMA = "vec_id long, embedding array<double>, n string, v string"


def plain(vectors, most=32):
    """(deviations, whitened by the dense eigenvectors, explained) in Python's whole numbers and one dense matrix."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    deviations = [sum(c * c for c in row) for row in apart]
    centred = np.array(apart, dtype=float) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    kept = values > 1e-11 * values[0]
    return deviations, centred @ axes[:, kept] / np.sqrt(values[kept]), values[kept] / np.trace(covariance)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_is_dense_whitening(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    deviations, whitened, explained = plain([r.embedding for r in rows])
    got = sorted(op13_whitening(spark, f"/root/testdata/{sf}").collect(), key=lambda r: (r.vec_id, r.component))
    width = len(explained)
    assert width == 32 and len(got) == width * len(rows)
    place = {r.vec_id: k for k, r in enumerate(rows)}
    table = np.zeros((len(rows), width))
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviations[place[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    turned = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * turned - whitened).max() < 1e-8


def test_steep_spectrum_needs_no_full_dimension(spark):
    draw = np.random.default_rng(4)
    scale = 2.0 ** -np.arange(80)
    turn = np.linalg.qr(draw.normal(size=(80, 80)))[0]
    vectors = draw.normal(size=(600, 80)) * (200 * scale) @ turn
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows, dim = sound_vectors(df, "vec_id", "embedding")
    steep, flat = fit_whitening(rows, dim, components=4, passes=12), fit_whitening(rows, dim, components=40, passes=2)
    assert not steep.expanded and flat.expanded
    want = plain(vectors.tolist(), 4)
    got = steep.eigenvalues / steep.trace
    assert np.abs(got / want[2] - 1).max() < 1e-10
    out = {(r.vec_id, r.component): r.whitened for r in whiten(df, components=4).collect()}
    table = np.array([[out[k, c + 1] for c in range(4)] for k in range(600)])
    assert np.abs(table * np.sign((table * want[1]).sum(axis=0)) - want[1]).max() < 1e-7


def test_rows(spark):
    """Nulls, non-finite entries, other lengths, null and repeated ids, repeated rows, huge entries, clashing columns."""
    inf, nan = float("inf"), float("nan")
    vectors = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-2.0, 3.25]), (4, [1e15, -7.0]), (5, [0.0, 0.0])]
    bad = [(6, None), (7, [1.0, nan]), (8, [-inf, 1.0]), (9, [None, 1.0]), (10, []), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in vectors + bad], SCHEMA)
    got = whiten(df).collect()
    deviations = plain([v for _, v in vectors])[0]
    fits = [d if d < 1 << 63 else None for d in deviations]
    assert {r.component for r in got} in ({1}, {1, 2}) and {r.n for r in got} == {5}
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str((i, d)) for (i, _), d in zip(vectors, fits, strict=True))
    assert any(d is None for d in fits)


def test_deviations_are_exact_beyond_doubles(spark):
    vectors = [(k, [3.7e5 * k, -1.9e5 * k + 0.5]) for k in range(8)]
    got = whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got} == dict(enumerate(plain([v for _, v in vectors])[0]))
    assert max(r.deviation for r in got) > 1 << 53 and {r.component for r in got} == {1}


def test_tables_without_spread(spark):
    for rows in ([], [(0, None, "", "")], [(20, [1.0, 2.0], "", "")], [(1, [1.0], "", ""), (2, [1.0], "", "")]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
