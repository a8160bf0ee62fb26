import random

import numpy as np
import pytest
from plain_versions import repeats

from loomtext.llm import substring_dedup
from loomtext.llm.substring_dedup import Windows, packed, remove_repeats, unpacked

DRAW = random.Random(4)


def words(n, of=400):
    return " ".join(f"w{DRAW.randrange(of)}" for _ in range(n))


def corpus():
    passage, long = words(60), words(3000)
    texts = {k: words(DRAW.randint(0, 120)) for k in range(80)}
    texts |= {100 + k: f"{words(7)} {passage} \n{words(9)}" for k in range(20)}
    texts |= {200 + k: long for k in range(5)}
    texts |= {300: " ".join(["same"] * 500), 301: None, 302: "", 303: long[:9000], 304: words(19), 305: "é\x85ü\xa0 " * 40}
    return texts


def run(df, **options):
    return remove_repeats(df, schema="n_words long, n_removed long, kept_sha256 string", project=substring_dedup.Removal.digest, **options)


@pytest.mark.parametrize("size", [22, 8])
def test_same_as_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE", size)
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: tuple(r)[1:] for r in run(df, most_ranges=3).collect()}
    assert got == repeats(texts)


def test_settling_in_blocks_and_buckets(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("BUCKET", 64), ("FRAGMENT", 100)):
        monkeypatch.setattr(substring_dedup, name, value)
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in run(df).collect()} == repeats(texts)


def test_rows(spark):
    text, other = words(50), words(30)
    rows = [(3, text, 1), (3, text, 1), (3, f"{text} x", 2), (None, text, 3), (None, other, 4), (9, f"{other} {other}", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in run(df).collect())
    assert got == [(0, 30, 30), (0, 50, 50), (3, 50, 0), (3, 50, 0), (3, 51, 0), (9, 60, 30)]
    assert run(df.limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in remove_repeats(df.filter("doc_id = 9")).collect()}
    assert kept[9] == other


def test_hashes_tell_windows_apart():
    texts = [words(100, 3), words(40, 2), None, "a"]
    for size in (1, 2, 3, 7, 20):
        own = Windows(texts, size)
        exact = [tuple((t or "").split()[a : a + size]) for t, a in ((texts[r], a) for r, a in zip(own.row, own.at))]
        assert len(exact) == sum(max(0, len((t or "").split()) - size + 1) for t in texts)
        assert len(set(zip(own.h.tolist(), own.g.tolist()))) == len(set(exact))


def test_packing():
    draw = np.random.default_rng(0)
    for top in (100, 10_000, 1 << 31):
        numbers = np.unique(draw.integers(0, top, 500))
        assert (unpacked(packed(numbers)) == numbers).all()
    assert len(unpacked(packed(np.zeros(0, np.int64)))) == 0
