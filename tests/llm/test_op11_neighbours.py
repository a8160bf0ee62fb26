import numpy as np
import pytest

from loomtext.llm.neighbours import BITS, BinaryCodes, Block, nearest_neighbours
from loomtext.llm.queries import op11_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, score string, block string"


def plain(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) by looking at every pair; rows of (id, vector)."""
    out = []
    for at, (query, v) in enumerate(rows):
        if query is None or query % every:
            continue
        others = [((np.asarray(w) * np.asarray(v)).sum(), i) for n, (i, w) in enumerate(rows) if n != at]
        others.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(query, r + 1, i, s) for r, (s, i) in enumerate(others[:k])]
    return out


def recall(got, want):
    found = {(r[0], r[2]) for r in got}
    return sum((w[0], w[2]) in found for w in want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_finds_what_brute_force_finds(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = plain(rows), [tuple(r) for r in op11_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()]
    assert len(got) == len(want) and recall(got, want) >= 0.9
    scores = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(scores.get((q, i), s) - s) < 1e-12 for q, _, i, s in got)
    for q in {g[0] for g in got}:
        own = sorted(g for g in got if g[0] == q)
        assert [g[1] for g in own] == list(range(1, 21)) and q not in {g[2] for g in own}
        assert [(-g[3], g[2]) for g in own] == sorted((-g[3], g[2]) for g in own)


def test_crowds_norms_and_many_blocks(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(4, 24))
    near = centre[draw.integers(0, 4, 1500)] + 0.3 * draw.normal(size=(1500, 24))
    rows = [(k, (v * draw.uniform(0.5, 2)).tolist()) for k, v in enumerate(near)]
    rows += [(5000 + k, centre[0].tolist()) for k in range(700)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=300, within=400).collect()
    want = plain(rows)
    assert len(got) == len(want) and recall([tuple(r) for r in got], want) >= 0.9
    copies = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 5000]
    scores = {r.vec_id: r.score for r in got if r.query_id == 5000}
    tied = [i for i in copies if i >= 5000 and abs(scores[i] - scores[copies[-1]]) < 1e-9]
    assert tied == sorted(tied)


def test_probing_retrieves_every_code_in_the_radius():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2, (1, BITS))
    bits = np.where(draw.random((600, BITS)) < draw.uniform(0, 0.5, (600, 1)), 1 - base, base)
    codes = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
    block = Block(codes, np.ones((600, 2)), [[k] for k in range(600)])
    apart = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
    for radius in (0, 1, 7, 15, 16, 17, 40, 90, 128, BITS):
        assert block.probe(codes[0], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_codes_of_wide_and_of_few_vectors():
    draw = np.random.default_rng(6)
    for shape in ((40, 300), (1, 3), (50, 7)):
        sample = draw.normal(size=shape)
        norms = np.linalg.norm(sample, axis=1)
        codes = BinaryCodes.learn(sample, norms.max(), norms.min())
        assert codes.sample.shape == (shape[0], BITS // 64)
        assert codes.of_queries(sample).shape == codes.sample.shape and codes.radius(codes.sample[0], 10) == BITS


def test_rows(spark):
    """Nulls, zeros, non-finite entries, other lengths, null and repeated ids, repeated rows, ties, clashing columns."""
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (20, [1.0, 1.0]), (None, [1.0, 0.0]), (3, [-1.0, 0.5]), (3, [-1.0, 0.5]), (7, [0.0, 2.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [1.0, nan]), (100, [inf, 1.0]), (120, [1.0, None]), (140, []), (160, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in vectors + bad], SCHEMA)
    got = sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest_neighbours(df).collect()), key=str)
    assert got == sorted(((q, r, i, round(float(s), 9)) for q, r, i, s in plain(vectors)), key=str)
    few = nearest_neighbours(df, k=2).collect()
    assert len(few) == 2 * 4 and max(r["rank"] for r in few) == 2


def test_empty_tables(spark):
    for rows in ([], [(0, None, "", "")], [(20, [0.0, 0.0], "", "")], [(20, [1.0], "", "")], [(1, [1.0], "", ""), (2, [1.0], "", "")]):
        out = nearest_neighbours(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
