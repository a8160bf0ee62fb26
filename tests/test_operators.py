import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.operators import corpus as c
from loomtext.operators import features as ft
from loomtext.operators import model as m
from loomtext.operators import quality as q
from loomtext.operators import ranking as rk
from loomtext.operators import report as rp
from loomtext.operators import sampling as sp
from loomtext.operators import segments as sg


def test_schema_and_first_come_dedup(spark):
    a = spark.createDataFrame([("0001", "AD", "x", None, " ", 1), ("2", "HC", None, "", "en", 2)], "ID string, Diagnosis string, Text_interviewer_participant string, Dataset string, Languages string, extra int")
    b = spark.createDataFrame([("0001", "HC", "other")], "id string, label string, transcript string").withColumn("Dataset", F.lit("A"))
    out = c.dedup_records(c.union_corpora([("A", a), ("B", b)]))
    rows = {r.ID: r for r in out.collect()}
    assert rows["0001"].Text_interviewer_participant == "x" and rows["0001"].Dataset == "A" and rows["0001"].Languages == "zh"
    assert rows["2"].Text_interviewer_participant == "" and rows["2"].extra == 2
    with pytest.raises(ValueError):
        c.union_corpora([("A", None)])
    with pytest.raises(ValueError):
        c.normalise_schema(a.drop("ID"), "A")
    with pytest.raises(Exception, match="unknown"):
        c.assert_known_labels(c.map_labels(a.withColumn("Diagnosis", F.lit("zz")))).count()
    with pytest.raises(ValueError):
        c.binary_only(a.withColumn("Diagnosis", F.lit("MCI")))
    with pytest.raises(ValueError):
        c.assert_class_sizes(a, "Diagnosis", 2)


def test_length_guard_and_quality(spark):
    def rows(n):
        return spark.createDataFrame([("AD", "x" * (10 + k % 3)) for k in range(n - 1)] + [("AD", "x" * 500)], "y string, t string")

    assert q.length_filter(rows(29), "t", "y", 1.0).count() == 29
    assert q.length_filter(rows(30), "t", "y", 1.0).count() == 29
    assert q.length_filter(rows(40), "t", "y", 1e9).count() == 40
    with pytest.raises(ValueError):
        q.length_filter(rows(3), "t", "y", -1)
    one = q.length_stats(spark.createDataFrame([("a", "xy")], "y string, t string"), "t", "y").first()
    assert one.std_len == 0.0
    df = spark.createDataFrame([("看到一隻貓在桌子上面跑來跑去很快",), ("【聽不清楚】" * 4,), ("",), (None,)], "t string")
    assert [r.t for r in q.quality_filter(df, "t").collect()] == ["看到一隻貓在桌子上面跑來跑去很快"]
    counts = q.drop_counters(df, "t").first()
    assert (counts.n_before, counts.n_after, counts.n_high_unknown, counts.n_short) == (4, 1, 1, 2)


def test_segments(spark):
    rows = [("u", 0, "2", "<B>", " b "), ("u", 1, "1", "B", "a"), ("u", 2, "x", " B ", "z"), ("u", 3, "0", "sil", "q"), ("u", 4, "0", "B", "SP"), ("u", 5, "0", "A", "no"), ("v", 0, "1", "B", "  ")]
    df = spark.createDataFrame(rows, "uid string, seq int, no string, speaker string, value string")
    kept = sg.filter_segments(df, keep_speakers=["<B>"])
    texts = sg.segments_to_text(kept)
    assert [tuple(r) for r in texts.collect()] == [("u", "a b z")]
    assert [tuple(r) for r in sg.segments_to_text(kept, order_by=None).collect()] == [("u", "b a z")]
    people = spark.createDataFrame([("u",), ("v",), ("w",)], "uid string")
    assert sorted(tuple(r) for r in sg.subjects_with_text(people, df, texts).collect()) == [("u", "a b z"), ("v", "")]
    assert [r.uid for r in sg.subjects_without_file(people, df).collect()] == ["w"]
    with pytest.raises(ValueError):
        sg.filter_segments(df.drop("speaker"), keep_speakers=["B"])
    meta = spark.createDataFrame([("u", "AD", 3)], "uuid string, Diagnosis string, age int")
    assert sg.join_features(meta, spark.createDataFrame([("u", 1.0)], "uuid string, f1 double")).columns == ["uuid", "Diagnosis", "age", "f1"]
    with pytest.raises(ValueError):
        sg.join_features(meta, spark.createDataFrame([("u", 1)], "uuid string, age int"))


def test_folds_and_balancing(spark):
    df = spark.createDataFrame([(k, int(k < 8)) for k in range(21)], "row_id long, y int")
    folded = sp.stratified_folds(df, n_splits=5, seed=1, keys=["row_id"], label_col="y")
    sizes = {(r.fold, r.y): r["count"] for r in folded.groupBy("fold", "y").count().collect()}
    assert sum(sizes.values()) == 21
    labels = sorted([0] * 13 + [1] * 8)
    assert sizes == {(f, y): labels[f::5].count(y) for f in range(5) for y in (0, 1) if labels[f::5].count(y)}
    train = sp.train_test_rows(folded, 5).filter("not is_test")
    down = sp.downsample(train, seed=1, keys=["row_id"], label_col="y").groupBy("k").pivot("y").count().collect()
    assert all(r["0"] == r["1"] for r in down)
    up = sp.upsample(train, seed=1, keys=["row_id"], label_col="y")
    assert all(r["0"] == r["1"] for r in up.groupBy("k").pivot("y").count().collect())
    assert up.groupBy("k", "y", "slot").count().filter("count > 1").count() == 0
    assert sp.sample_classes(df, seed=1, keys=["row_id"], label_col="y", cap=3).count() == 6
    assert sp.sample_classes(df, seed=1, keys=["row_id"], label_col="y", cap=0).count() == 0
    assert sp.sample_classes(df, seed=1, keys=["row_id"], label_col="y", balance=True).count() == 16
    with pytest.raises(ValueError):
        sp.stratified_folds(df, n_splits=1, seed=1, keys=["row_id"], label_col="y")
    with pytest.raises(ValueError):
        sp.balance_train(train, "other")


def test_tfidf_model_is_the_relational_form(spark):
    df = spark.createDataFrame([(0, "abab"), (1, "abc"), (2, "")], "id long, text string")
    vectors = ft.fit_tfidf(df, "text", least=2, most=2)
    own = {r.id: r.features.toArray() for r in vectors.transform(df, "text").collect()}
    at = {g: k for k, g in enumerate(vectors.vocabulary)}
    weights = {"ab": 2 * (math.log(4 / 3) + 1), "ba": math.log(4 / 2) + 1}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    assert all(abs(own[0][at[g]] - w / norm) < 1e-12 for g, w in weights.items())
    assert abs(np.linalg.norm(own[1]) - 1) < 1e-12 and not own[2].any()
    counts = ft.gram_counts(df, ["id"], ft.char_ngrams(F.col("text"), 2, 2))
    for r in ft.tfidf(counts, df, ["id"]).collect():
        assert abs(r.weight - own[r.id][at[r.gram]]) < 1e-12


def test_ranks_are_those_of_a_window_and_no_task_holds_a_class(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise((F.col("id") % 7 == 0).cast("int")).alias("y"), (F.col("id") % 40).alias("t"))
    by_hash = rk.rank_by_hash(df, ["y"], F.md5(F.col("id").cast("string")), ["id"])
    in_order = rk.rank_in_order(df.repartition(9), ["y"], ["t", "id"])
    for found, order in ((by_hash, [F.md5(F.col("id").cast("string"))]), (in_order, ["t", "id"])):
        want = df.withColumn("_rank", F.row_number().over(Window.partitionBy("y").orderBy(*order)).cast("long"))
        assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = by_hash._jdf.queryExecution().executedPlan().toString()
    assert all("_cell" in line for line in plan.splitlines() if "Window [row_number" in line)
    numbers = rk.numbered(df.repartition(9), ["t", "id"]).collect()
    assert [r.id for r in sorted(numbers, key=lambda r: r.row_id)] == [r.id for r in df.orderBy("t", "id").collect()]
    assert sorted(r.row_id for r in numbers) == list(range(5000)) and rk.numbered(df.limit(0), ["id"]).count() == 0


def test_first_rows_by_hash_are_those_of_the_ranks(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(3))).alias("y"), (F.col("id") % 2).alias("k"))
    same = F.md5(F.floor(F.col("id") / 40).cast("string"))  # forty rows share a hash, so ties decide
    ranked = rk.rank_by_hash(df, ["k", "y"], same, ["id"])
    for most, want in ((F.lit(700), "_rank <= 700"), (F.lit(0), "false"), (F.lit(10**6), "true")):
        got = rk.first_by_hash(df, ["k", "y"], same, ["id"], most.cast("long"))
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ranked.filter(want).drop("_rank").collect()), key=str)
    assert rk.first_by_hash(df.limit(0), ["k"], same, ["id"], F.lit(5).cast("long")).count() == 0
    one = df.filter("y = 1")
    assert sp.downsample(one, seed=1, keys=["id"], label_col="y").count() == one.count()


def test_first_rows_and_top_grams_are_those_of_a_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("k"), (F.col("id") * 7919 % 3001).alias("o"), F.array("id").alias("a"), F.col("id").cast("string").alias("o text"))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o"))).filter("r = 1").drop("r")
    got = c.keep_first(df, ["k"], ["o"])
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len(got.collect()) == 12
    counts = spark.range(4000).select((F.col("id") % 3).alias("s"), F.concat(F.lit("g"), F.col("id") % 400).alias("gram"), (F.col("id") % 13).alias("tf"))
    totals = counts.groupBy("s", "gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    best = totals.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("total"), "gram"))).filter("r <= 20").drop("r")
    assert sorted(map(tuple, ft.top_grams(counts, 20, ["s"]).collect())) == sorted(map(tuple, best.collect()))


def test_upsampling_makes_its_slots_in_blocks(spark, monkeypatch):
    df = spark.range(90).select(F.lit(0).alias("k"), F.col("id"), (F.col("id") < 70).cast("int").alias("y"))
    whole = sorted(map(tuple, sp.upsample(df, seed=3, keys=["id"], label_col="y").collect()))
    monkeypatch.setattr(sp, "SLOTS", 8)
    assert sorted(map(tuple, sp.upsample(df, seed=3, keys=["id"], label_col="y").collect())) == whole and len(whole) == 140


def test_fold_records(spark):
    df = spark.createDataFrame([(k, int(k < 8)) for k in range(21)], "row_id long, y int")
    folded = sp.stratified_folds(df, n_splits=4, seed=1, keys=["row_id"], label_col="y")
    rows = [(r.row_id, r.y, r.fold) for r in folded.collect()]
    for strategy in ("none", "downsample", "upsample"):
        for r in m.fold_records(folded, strategy).collect():
            train = folded.filter(F.col("fold") != r.fold).select("row_id", "y", F.lit(r.fold).alias("k"))
            own = sp.balance_train(train, strategy, **({} if strategy == "none" else dict(seed=1, keys=["row_id"], label_col="y"))).collect()
            test = [y for _, y, f in rows if f == r.fold]
            assert (r.n_train, r.n_train_before_balance, r.n_test) == (len(own), 21 - len(test), len(test))
            assert (r.train_HC, r.train_AD, r.test_HC, r.test_AD) == (*[sum(x.y == y for x in own) for y in (0, 1)], *[test.count(y) for y in (0, 1)])
    with pytest.raises(ValueError):
        sp.balanced_counts(df, "other")


def newton(x, y, w, penalty):
    x1, b = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * x.shape[1] + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ b))
        b -= np.linalg.solve((x1.T * (w * p * (1 - p))) @ x1 + ridge, x1.T @ (w * (p - y)) + ridge @ b)
    return b


def test_logistic_regression_against_newton(spark):
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(60, 3)), (np.arange(60) < 20).astype(int)
    x[:20] += 0.8
    df = spark.createDataFrame([(Vectors.dense(a), int(b)) for a, b in zip(x, y)], ["features", "y"])
    model = m.fit_logistic(df, c=1.0)
    w = np.where(y == 1, 60 / (2 * 20), 60 / (2 * 40))
    want = newton(x, y, w, 1.0)
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-4)
    with pytest.raises(ValueError):
        m.fit_logistic(df, solver="saga")


def test_fold_vocabulary_comes_from_training_rows(spark):
    rows = [(k, "aaaa" if k % 2 else "bbbb", k % 2, k // 2 % 3) for k in range(24)] + [(99, "zzzz", 1, 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, y int, fold int")
    found = m.cross_validate_tfidf(df, 3, text_col="text", keys=["row_id"], balance="downsample", max_iter=50)
    assert found.count() == 25 and found.filter("row_id < 99 and y <> yhat").count() == 0
    assert "zz" not in ft.fit_tfidf(df.filter("fold <> 0"), "text").vocabulary


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0)], "fold int, y int, yhat int")
    got = {r.fold: r for r in m.metrics(m.confusion(df)).collect()}
    assert abs(got[0].accuracy - 2 / 3) < 1e-12 and abs(got[0].precision - 0.75) < 1e-12 and abs(got[0].recall - 0.75) < 1e-12
    assert got[1].f1 == got[1].precision == 1.0
    weighted = m.metrics(m.confusion(df), average="weighted").filter("fold = 0").first()
    assert abs(weighted.recall - 2 / 3) < 1e-12
    assert m.classification_report(m.confusion(df)).count() == 8
    assert abs(m.summary(m.metrics(m.confusion(df))).first().accuracy_std - np.std([2 / 3, 1])) < 1e-12


def test_reports(spark):
    assert abs(rp.chi_squared_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(rp.chi_squared_tail(0.5, 4) - 0.9735009788392561) < 1e-9
    series = spark.createDataFrame([(n, k, float(v)) for n, vs in {"a": [1, 2, 3, 4], "b": [2, 3, 4, 5], "c": [3, 4, 5, 6], "d": [9]}.items() for k, v in enumerate(vs)], "method string, fold int, value double")
    three = series.filter("method <> 'd'")
    assert abs(rp.friedman(three).first().statistic - 8.0) < 1e-9
    assert rp.friedman_text(three) == "Friedman p = 0.018"
    assert rp.friedman_text(three.filter("method <> 'c'")) == ""
    assert rp.shared_folds(series).count() == 4 and rp.shared_folds(series, 2).count() == 12
    box = rp.box_plot_stats(spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double"), F.col("v"), ["g"]).first()
    assert (box.q1, box.median, box.q3, box.whisker_high, box.n_fliers) == (2, 3, 4, 4, 1)
    summaries = spark.createDataFrame([(n, *[0.5, 0.1] * 4) for n in ("zeta", "glove", "tfidf")], "method string, " + ", ".join(f"{x}_mean double, {x}_std double" for x in m.METRICS))
    table = rp.results_table(summaries)
    assert [r.Model for r in table.collect()] == ["TF-IDF (char 2–4gram)", "fastText/GloVe (300d)", "zeta"] and table.first()[1] == "50.00 ± 10.00"
    assert r"\toprule" in rp.to_latex(table)


def test_vectors_encoder_and_svd(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "zzz"), (3, None)], "id long, text string")
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 6.0])], "word string, vec array<float>")
    got = {r.id: r.vector for r in ft.pooled_vectors(df, vectors, id_col="id", words=F.split(F.coalesce("text", F.lit("")), " "), dim=2).collect()}
    assert np.allclose(got[1], [2**-0.5, 2**-0.5]) and got[2] == [0, 0] == got[3]

    def load():
        return lambda texts: [([[[float(len(t)), 1.0], [0.0, 2.0]]] * 5, [1, 0]) for t in texts]

    for pooling, want in (("mean", [5.0, 1.0]), ("cls", [5.0, 1.0]), ("last4_concat_mean", [5.0, 1.0] * 4)):
        out = ft.encode_texts(df, "text", load, pooling=pooling).filter("id = 1").first().embedding
        assert np.allclose(out, want)
    x = np.random.default_rng(3).normal(size=(30, 4)) * [5, 3, 1, 0.5]
    frame = spark.createDataFrame([(k, Vectors.dense(r)) for k, r in enumerate(x)], ["id", "features"])
    scores, shares = ft.truncated_svd(frame, "id")
    assert "Python" not in scores._jdf.queryExecution().executedPlan().toString()
    sparse = spark.createDataFrame([(k, Vectors.sparse(4, [(j, float(v)) for j, v in enumerate(r)])) for k, r in enumerate(x)], ["id", "features"])
    assert np.allclose([r.scores for r in ft.truncated_svd(sparse, "id")[0].orderBy("id").collect()], [r.scores for r in scores.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(shares, [np.var(u[:, j] * s[j]) / np.var(x, axis=0).sum() for j in range(2)])
    own = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(own), np.abs(u[:, :2] * s[:2]), atol=1e-8) and 0.7 < sum(shares) < 1
    model = m.fit_logistic(frame.withColumn("y", (F.col("id") % 2).cast("int")).join(scores, "id").withColumn("features", ft.to_vector(F.col("scores"))))
    assert rp.decision_grid(model, scores, side=10).filter("p1 between 0 and 1").count() == 100
