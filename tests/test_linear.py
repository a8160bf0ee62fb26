"""Regressions of all splits, the range finder and the vectoriser's options against numpy and plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loomtext.operators import features as ft
from loomtext.operators import linear
from loomtext.operators import model as m
from loomtext.operators import sampling as sp
from loomtext.plans.crossval import encoder_options, vectoriser_options


def newton(x, y, w, c):
    full, at = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], 1 / c), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(full @ at)))
        at = at - np.linalg.solve((full.T * (w * p * (1 - p))) @ full + np.diag(ridge), full.T @ (w * (p - y)) + ridge * at)
    return at


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(150, 6)) * (draw.random((150, 6)) < 0.6), (draw.random(150) < 0.4).astype(int)
    x[y == 1, :2] += 0.7
    w = np.where(draw.random((150, 3)) < 0.7, draw.integers(1, 4, (150, 3)), 0).astype(float)
    return x, y, w


@pytest.mark.parametrize("kind", ["dense", "sparse", "mixed", "array"])
@pytest.mark.parametrize("newton_dim", [300, 0])
def test_all_splits_at_once_are_the_single_fits(spark, monkeypatch, data, kind, newton_dim):
    monkeypatch.setattr(linear, "NEWTON_DIM", newton_dim)
    x, y, w = data
    sparse = [Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(r) if v]) for r in x]
    dense = [Vectors.dense(r) for r in x]
    own = {"dense": dense, "sparse": sparse, "mixed": [d if k % 2 else s for k, (d, s) in enumerate(zip(dense, sparse, strict=True))], "array": x.tolist()}[kind]
    df = spark.createDataFrame(list(zip(own, y.tolist(), w.tolist(), strict=True)), ["features", "y", "weights"])
    got = linear.fit_splits(df.repartition(3), 3, c=0.7)
    want = np.stack([newton(x, y, w[:, k], 0.7) for k in range(3)])
    assert np.abs(got - want).max() < 1e-6
    keyed = df.withColumn("id", F.monotonically_increasing_id()).withColumn("fold", F.col("y"))
    said = linear.predict_splits(keyed, got, keys=["id"]).orderBy("id").collect()
    assert [r.yhat for r in said] == [int(x[k] @ want[y[k], :-1] + want[y[k], -1] > 0) for k in range(150)]


def test_a_split_of_one_label_says_that_label(spark):
    df = spark.createDataFrame([([1.0], 1, [1.0, 1.0, 0.0], 0), ([2.0], 0, [1.0, 0.0, 0.0], 1), ([3.0], 1, [1.0, 2.0, 0.0], 2)], "features array<double>, y int, weights array<double>, fold int")
    got = linear.fit_splits(df, 3)
    assert np.isfinite(got[0]).all() and got[1, -1] == np.inf and got[2].tolist() == [0.0, 0.0]
    assert {r.fold: r.yhat for r in linear.predict_splits(df, got, keys=[]).collect()}[1] == 1


def test_cross_validation_trains_on_the_drawn_rows(spark, data):
    x, y, _ = data
    df = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(150)], "row_id long, y int, features array<double>")
    folded = sp.stratified_folds(df, n_splits=3, seed=5, keys=["row_id"], label_col="y")
    fold = {r.row_id: r.fold for r in folded.collect()}
    for balance in ("none", "downsample", "upsample"):
        got = {r.row_id: r.yhat for r in m.cross_validate(folded, 3, keys=["row_id"], balance=balance, seed=9).collect()}
        train = sp.balance_train(sp.train_test_rows(folded.drop("features"), 3).filter("not is_test"), balance, **({} if balance == "none" else {"seed": 9, "keys": ["row_id"], "label_col": "y"}))
        drawn = Counter((r.k, r.row_id) for r in train.collect())
        for k in range(3):
            count = np.array([drawn[k, i] for i in range(150)], dtype=float)
            size = {c: count[y == c].sum() for c in (0, 1)}
            w = count * np.array([count.sum() / (2 * size[c]) for c in y])
            at = newton(x, y, w, 1.0)
            assert all(got[i] == int(x[i] @ at[:-1] + at[-1] > 0) for i in range(150) if fold[i] == k)


def test_range_finder_on_many_sparse_columns(spark):
    draw = np.random.default_rng(2)
    rows, dim = 300, 50_000
    used = draw.choice(dim, 400, replace=False)
    x = np.zeros((rows, dim))
    x[:, used] = draw.normal(size=(rows, 6)) * [40, 25, 10, 6, 4, 3] @ draw.normal(size=(6, 400)) + 0.1 * draw.normal(size=(rows, 400))
    x[:, used] *= draw.random((rows, 400)) < 0.5
    df = spark.createDataFrame([(k, Vectors.sparse(dim, [(int(j), float(r[j])) for j in sorted(used) if r[j]])) for k, r in enumerate(x)], ["id", "features"])
    found, values = linear.leading_directions(df, k=2, passes=25)
    u, s, v = np.linalg.svd(x[:, used], full_matrices=False)
    assert np.allclose(values, s[:2], rtol=1e-6)
    assert np.abs(np.abs((v[:2] * found[used].T).sum(axis=1)) - 1).max() < 1e-6
    scores, shares = ft.truncated_svd(df, "id")
    assert scores.count() == rows and 0 < sum(shares) < 1
    exact, _ = linear.leading_directions(df.select(F.transform(F.array(*[F.lit(j) for j in range(3)]), lambda j: j + F.col("id") * (j + 1) % 7).cast("array<double>").alias("features")), k=2)
    assert exact.shape == (3, 2)


def test_few_sparse_columns_are_squared_by_dense_parts(spark, monkeypatch):
    """The rows' own product in place of one pass over the sparse rows for each column; a row without a value counts too."""
    monkeypatch.setattr(linear, "DENSE_CELLS", 30)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(50, 12)) * (draw.random((50, 12)) < 0.4)
    x[7] = 0
    df = spark.createDataFrame([(k, Vectors.sparse(12, [(j, float(v)) for j, v in enumerate(r) if v])) for k, r in enumerate(x)], ["id", "features"])
    rows = df.select(linear.feature_struct(df, "features").alias("x")).toArrow().to_batches()
    assert np.allclose(sum(linear.Rows(b.column(0), 12).squared() for b in rows), x.T @ x)
    assert np.allclose(linear.leading_directions(df, k=3)[1], np.linalg.svd(x, compute_uv=False)[:3])


TEXTS = ["Der Hund, der Hund", "a b cc the cc", "", "Ünï cödé  x1 y2\tx1", "cc dd Hund", "hund"]


def grams(text, analyzer, least, most, lowercase, stop):
    text = text.lower() if lowercase else text
    if analyzer == "char":
        return [text[k : k + n] for n in range(least, most + 1) for k in range(len(text) - n + 1)]
    if analyzer == "word":
        words = [w for w in re.findall(r"\b\w\w+\b", text) if w not in (stop or ())]
        return [" ".join(words[k : k + n]) for n in range(least, most + 1) for k in range(len(words) - n + 1)]
    out = []
    for word in text.split():
        word = f" {word} "
        for n in range(least, most + 1):
            out += [word[k : k + n] for k in range(max(len(word) - n, 0) + 1)]
            if n >= len(word):
                break
    return out


CASES = [
    {}, {"sublinear_tf": True}, {"norm": "l1"}, {"norm": None}, {"use_idf": False}, {"smooth_idf": False, "sublinear_tf": True, "norm": "l1"}, {"lowercase": True, "norm": None, "sublinear_tf": True},
    {"analyzer": "word", "least": 1, "most": 2, "lowercase": True, "stop_words": ["the", "der"]}, {"analyzer": "char_wb", "least": 2, "most": 5}, {"min_df": 2}, {"max_df": 0.34}, {"min_df": 0.3, "max_df": 3, "lowercase": True},
    {"max_features": 5}, {"analyzer": "word", "least": 1, "most": 1, "max_features": 3, "use_idf": False},
]


@pytest.mark.parametrize("options", CASES, ids=str)
def test_vectoriser_options(spark, options):
    o = {"analyzer": "char", "least": 2, "most": 4, "lowercase": False, "stop_words": None, "use_idf": True, "smooth_idf": True, "norm": "l2", "sublinear_tf": False, "min_df": 1, "max_df": 1.0, "max_features": None} | options
    counts = [Counter(grams(t, o["analyzer"], o["least"], o["most"], o["lowercase"], o["stop_words"])) for t in TEXTS]
    total, df, n = Counter(), Counter(), len(TEXTS)
    for c in counts:
        total.update(c)
        df.update(c.keys())
    bound = lambda b: b * n if isinstance(b, float) and b <= 1 else b
    kept = sorted((g for g in total if bound(o["min_df"]) <= df[g] <= bound(o["max_df"])), key=lambda g: (-total[g], g.encode()))[: o["max_features"]]
    idf = {g: 1.0 if not o["use_idf"] else 1 + (math.log((1 + n) / (1 + df[g])) if o["smooth_idf"] else math.log(n / df[g])) for g in kept}
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    model = ft.fit_tfidf(frame, "text", **o)
    assert model.vocabulary == kept
    for r in model.transform(frame, "text").collect():
        raw = {g: (1 + math.log(c) if o["sublinear_tf"] else c) * idf[g] for g, c in counts[r.id].items() if g in idf}
        size = {"l1": sum(raw.values()), "l2": math.sqrt(sum(v * v for v in raw.values())), None: 1.0}[o["norm"]] or 1.0
        got = {kept[i]: v for i, v in zip(r.features.indices, r.features.values, strict=True)}
        assert got.keys() == raw.keys() and all(abs(got[g] - raw[g] / size) < 1e-12 for g in raw)


def test_options_that_cannot_be_done_are_errors(spark):
    own = {"vectorizer": {"analyzer": "char", "ngram_range": "2,3", "lowercase": True, "min_df": 2}, "transformer": {"sublinear_tf": True, "norm": None}}
    found = vectoriser_options(own)
    assert found["lowercase"] and found["sublinear_tf"] and found["norm"] is None and found["min_df"] == 2 and (found["least"], found["most"]) == (2, 3)
    for bad in ({"vectorizer": {"binary": True}}, {"vectorizer": {}, "transformer": {"other": 1}}, {"vectorizer": {"stop_words": "english"}}, {"vectorizer": {"lowercase": "yes"}}):
        with pytest.raises(ValueError):
            vectoriser_options(bad)
    frame = spark.createDataFrame([(0, "ab")], "id long, text string")
    for bad in ({"analyzer": "other"}, {"norm": "max"}, {"min_df": 2}):
        with pytest.raises(ValueError):
            ft.fit_tfidf(frame, "text", **bad)


def test_heavy_grams_lose_none_and_ties_at_the_cut_are_settled_alike(spark):
    """Totals fall slowly and many tie at the cut; sketches that keep few items still give the exact first ones."""
    rows = [(k, g) for g in range(900) for k in range(3 + (g % 10 == 0) * 2 + (g < 40) * 5)]
    counts = spark.createDataFrame(rows, "id long, g long").select("id", F.concat(F.lit("g"), "g").alias("gram"), (1 + F.col("id") % 3).alias("tf")).repartition(5)
    totals = sorted(((r.gram, r.t) for r in counts.groupBy("gram").agg(F.sum("tf").alias("t")).collect()), key=lambda x: (-x[1], x[0]))
    for k in (1, 37, 60, 100, 899, 5000):
        assert [(r.gram, r.total) for r in ft.top_grams(counts, k).orderBy(F.desc("total"), "gram").collect()] == totals[:k]
    few = ft.heavy_grams(counts, 20).select("gram").distinct().count()
    assert 20 <= few < 900
    texts = spark.createDataFrame([(0, "ab cd ab"), (1, "ef cd gh")], "id long, text string")
    by_counts = [r.gram for r in ft.top_grams(ft.gram_counts(texts, ["id"], ft.analysed(F.col("text"), "word", 1, 1)), 3).orderBy(F.desc("total"), "gram").collect()]
    assert ft.fit_tfidf(texts, "text", analyzer="word", least=1, most=1, max_features=3).vocabulary == by_counts == ["ab", "cd", "ef"]


def test_encoders_get_batches_and_lengths(spark, tmp_path):
    config = {"crossval": {"batch_size": 7, "gemma_batch_size": 2}, "bert": {"max_seq_length": 3, "batch_size": 4}, "gemma": {"pooling": "cls"}, "linq": {}}
    found = {name: encoder_options(config, name) for name in ("bert", "gemma", "linq")}
    assert [(o["batch"], o["max_length"], o["pooling"]) for o in found.values()] == [(4, 3, "mean"), (2, None, "cls"), (7, None, "mean")]
    log = str(tmp_path / "log")

    def load():
        def encode(texts, max_length=None):
            with open(log, "a") as out:
                out.write(f"{len(texts)} {max_length}\n")
            return [([[[float(k), 1.0] for k in range(5)]] * 5, [1, 1, 1, 1, 0]) for _ in texts]

        return encode

    df = spark.range(10).select("id", F.lit("x").alias("text")).coalesce(1)
    rows = ft.encode_texts(df, "text", load, **found["bert"]).collect()
    assert {tuple(r.embedding) for r in rows} == {(1.0, 1.0)}
    assert open(log).read().split("\n")[:-1] == ["4 3", "4 3", "2 3"]
    assert ft.encode_texts(df, "text", lambda: lambda texts: load()(texts), **found["gemma"]).first().embedding == [0.0, 1.0]
    with pytest.raises(ValueError):
        ft.encode_texts(df, "text", load, batch=0)
