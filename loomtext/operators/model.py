"""Balanced logistic regression, cross-validation over given folds, and metrics as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.features import fit_tfidf
from loomtext.operators.linear import fit_splits, predict_splits
from loomtext.operators.sampling import balance_train, balanced_counts, train_test_rows
from loomtext.session import durable

METRICS = ("accuracy", "precision", "recall", "f1")


def class_weights(train: DataFrame, label_col: str = "y") -> DataFrame:
    """``weight`` = n / (classes * rows of the class), so that the weights add up to n."""
    sizes = train.groupBy(F.col(label_col).alias("_y")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = sizes.crossJoin(total).select("_y", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return train.join(table, F.col(label_col) == F.col("_y")).drop("_y")


def fit_logistic(train: DataFrame, *, c: float = 1.0, max_iter: int = 1000, balanced: bool = True, features_col: str = "features", label_col: str = "y", solver: str = "lbfgs") -> LogisticRegressionModel:
    """Ridge-penalised: the loss summed over weighted rows times C, plus half the squared weights; by L-BFGS."""
    if solver != "lbfgs":
        raise ValueError("only lbfgs is supported")
    rows = class_weights(train, label_col) if balanced else train.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn(label_col, F.col(label_col).cast("double")).select(features_col, label_col, "weight").cache()
    total = rows.agg(F.sum("weight")).first()[0]
    try:
        return LogisticRegression(
            featuresCol=features_col, labelCol=label_col, weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8
        ).fit(rows)
    finally:
        rows.unpersist()


def split_weights(folded: DataFrame, folds: int, *, keys: Sequence[str], balance: str = "none", seed: int = 42, balanced: bool = True, label_col: str = "y") -> DataFrame:
    """(keys, weights): how much each row counts in the training of each split, 0 where it is tested or wasn't drawn.

    Rows drawn more than once count as often; class weights are those of ``class_weights``. Only keys, folds and labels are
    moved, and features are never ranked.
    """
    slim = folded.select(*keys, "fold", F.col(label_col).alias("y"))
    slim = durable(slim) if balance != "none" else slim
    train = train_test_rows(slim, folds).filter("not is_test").select(*keys, "y", "k")
    train = balance_train(train, balance, seed=seed, keys=keys, label_col="y").select(*keys, "y", "k")
    train = durable(train) if balance != "none" else train
    weight = F.lit(1.0)
    if balanced:
        sizes = train.groupBy("k", "y").agg(F.count("*").alias("n")).collect()  # a row for each split and class
        totals = {k: (sum(r["n"] for r in sizes if r["k"] == k), sum(r["k"] == k for r in sizes)) for k in range(folds)}
        weight = F.lit(0.0)
        for r in sizes:
            weight = F.when((F.col("k") == r["k"]) & F.col("y").eqNullSafe(F.lit(r["y"])), totals[r["k"]][0] / (totals[r["k"]][1] * r["n"])).otherwise(weight)
    each = train.withColumn("w", weight)
    return each.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("k") == k, F.col("w")).otherwise(0.0)) for k in range(folds)]).alias("weights"))


def cross_validate(
    features: DataFrame, folds: int, *, keys: Sequence[str], balance: str = "none", seed: int = 42, label_col: str = "y", c: float = 1.0, max_iter: int = 1000, balanced: bool = True, solver: str = "lbfgs"
) -> DataFrame:
    """(keys, fold, y, yhat) of every row, predicted by the model that never saw its fold.

    ``features`` has fold, y and features, and ``keys`` that are unique. The models of all folds are fitted together
    (``linear.fit_splits``): one pass over the rows a step, whatever the number of folds.
    """
    if solver != "lbfgs":
        raise ValueError("only lbfgs is supported")
    weights = split_weights(features, folds, keys=keys, balance=balance, seed=seed, balanced=balanced, label_col=label_col)
    rows = features.select(*keys, "fold", F.col(label_col).alias("y"), "features").join(weights, list(keys), "left")
    none = F.array(*[F.lit(0.0)] * folds)
    rows = durable(rows.withColumn("weights", F.coalesce("weights", none)))
    fitted = fit_splits(rows, folds, c=c, max_iter=max_iter)
    return predict_splits(rows, fitted, keys=keys)


def cross_validate_tfidf(rows: DataFrame, folds: int, *, text_col: str, keys: Sequence[str], balance: str = "none", seed: int = 42, label_col: str = "y", vectoriser: Mapping | None = None, **logistic) -> DataFrame:
    """The same, with a vectoriser that is fitted on each split's training rows alone, after balancing."""
    rows = durable(rows)
    parts = []
    for k in range(folds):
        train = rows.filter(F.col("fold") != k)
        if balance != "none":
            train = balance_train(train, balance, seed=seed + k, keys=keys, label_col=label_col, by=())
        train = durable(train)
        vectors = fit_tfidf(train, text_col, **(vectoriser or {}))
        weighted = class_weights(train, label_col) if logistic.get("balanced", True) else train.withColumn("weight", F.lit(1.0))
        weighted = durable(vectors.transform(weighted.withColumn("weights", F.array("weight")), text_col).select("features", F.col(label_col).alias("y"), "weights"))
        fitted = fit_splits(weighted, 1, c=logistic.get("c", 1.0), max_iter=logistic.get("max_iter", 1000))
        test = vectors.transform(rows.filter(F.col("fold") == k), text_col).withColumn("y", F.col(label_col)).withColumn("_first", F.lit(0))
        found = predict_splits(test, fitted, keys=keys, fold_col="_first")
        parts.append(found.withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def confusion(predictions: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Counts of truth (first digit) and prediction (second) for labels 0 and 1."""
    return predictions.groupBy(*by).agg(*[F.count_if((F.col("y") == t) & (F.col("yhat") == p)).alias(f"n{t}{p}") for t in (0, 1) for p in (0, 1)])


def _per_class(zero: float) -> dict[str, tuple]:
    def ratio(a, b):
        return F.when(b == 0, F.lit(zero)).otherwise(a / b)

    out = {}
    for c, o in ((0, 1), (1, 0)):
        hit, said, true = F.col(f"n{c}{c}"), F.col(f"n{c}{c}") + F.col(f"n{o}{c}"), F.col(f"n{c}{c}") + F.col(f"n{c}{o}")
        p, r = ratio(hit, said), ratio(hit, true)
        out[c] = (p, r, ratio(2 * hit, said + true), true, (said + true) > 0)
    return out


def metrics(table: DataFrame, *, average: str = "macro", zero: float = 0.0, by: Sequence[str] = ("fold",)) -> DataFrame:
    """accuracy, precision, recall and f1 of each row of confusion counts.

    ``macro`` is the mean over the labels that occur as truth or prediction, ``weighted`` weighs by truth,
    ``micro`` counts all together, ``binary`` is label 1.
    """
    per = _per_class(zero)
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    accuracy = (F.col("n00") + F.col("n11")) / n

    def averaged(at: int):
        if average == "binary":
            return per[1][at]
        if average == "micro":
            return accuracy
        weight = {c: per[c][3] if average == "weighted" else per[c][4].cast("int") for c in per}
        return (per[0][at] * weight[0] + per[1][at] * weight[1]) / (weight[0] + weight[1])

    if average not in ("macro", "weighted", "micro", "binary"):
        raise ValueError(f"unknown average: {average}")
    return table.select(*by, accuracy.alias("accuracy"), *[averaged(k).alias(m) for k, m in enumerate(METRICS[1:])])


def classification_report(table: DataFrame, names: Sequence[str] = ("HC", "AD"), by: Sequence[str] = ("fold",)) -> DataFrame:
    """(by, class, precision, recall, f1, support) for both classes and their macro and weighted means."""
    per = _per_class(0.0)
    n = per[0][3] + per[1][3]
    rows = [F.struct(F.lit(names[c]).alias("class"), *[per[c][k].cast("double").alias(m) for k, m in enumerate(METRICS[1:])], per[c][3].alias("support")) for c in (0, 1)]
    for name, w0, w1, total in (("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0)), ("weighted avg", per[0][3], per[1][3], n)):
        rows.append(F.struct(F.lit(name).alias("class"), *[((per[0][k] * w0 + per[1][k] * w1) / total).cast("double").alias(m) for k, m in enumerate(METRICS[1:])], n.alias("support")))
    return table.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def label_counts(rows: DataFrame, by: Sequence[str], label_col: str = "y") -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(label_col) == 0).alias("HC"), F.count_if(F.col(label_col) == 1).alias("AD"))


def fold_records(folded: DataFrame, strategy: str, *, label_col: str = "y") -> DataFrame:
    """For each fold its rows: n_train, n_train_before_balance, n_test, and rows of each label in train and test.

    ``folded`` has fold and a label of 0 (HC) or 1 (AD); balancing makes every class that occurs as large as the smallest
    or the largest one. Only rows for fold and label are looked at after one count.
    """
    cells = folded.groupBy("fold", F.col(label_col).alias("y")).agg(F.count("*").alias("n"))
    splits = cells.select(F.col("fold").alias("k")).distinct()
    pairs = splits.crossJoin(cells)
    train = pairs.filter("fold <> k").groupBy("k", "y").agg(F.sum("n").alias("n"))
    test = pairs.filter("fold = k").groupBy("k").agg(F.sum("n").alias("n_test"), *_by_label("test"))
    before = train.groupBy("k").agg(F.sum("n").alias("n_train_before_balance"))
    after = balanced_counts(train, strategy).groupBy("k").agg(F.sum("n").alias("n_train"), *_by_label("train"))
    out = after.join(before, "k").join(test, "k")
    return out.select(F.col("k").alias("fold"), "n_train", "n_train_before_balance", "n_test", *[f"{part}_{name}" for part in ("train", "test") for name in ("HC", "AD")])


def _by_label(part: str) -> list:
    return [F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"{part}_{name}") for y, name in enumerate(("HC", "AD"))]


def summary(fold_metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds of each metric."""
    return fold_metrics.groupBy(*by).agg(*[f(m).alias(f"{m}_{name}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


FeatureBuilder = Callable[[DataFrame], DataFrame]


def run_methods(rows: DataFrame, methods: Mapping[str, FeatureBuilder], chosen: Sequence[str], folds: int, **options) -> DataFrame:
    """Predictions of all chosen methods over the same folds, with ``method``."""
    if unknown := [m for m in chosen if m not in methods]:
        raise ValueError(f"unknown methods: {unknown}")
    return reduce(DataFrame.unionByName, [cross_validate(methods[m](rows), folds, **options).withColumn("method", F.lit(m)) for m in chosen])
