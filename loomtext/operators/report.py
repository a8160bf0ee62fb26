"""Report tables: box plots, the Friedman test, formatted results, fold series, decision grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.quantiles import exact_quantiles, sent
from loomtext.session import durable

#: The order of the methods in tables; others follow by name.
METHOD_ORDER = ("tfidf", "bert", "glove", "gemma", "linq")
#: What methods are called in tables; others keep their key.
DISPLAY_NAMES = {
    "bert": "BERT-base (mean pooling)",
    "tfidf": "TF-IDF (char 2–4gram)",
    "glove": "fastText/GloVe (300d)",
    "gemma": "Gemma-2B (mean pooling)",
    "linq": "Linq-Embed-Mistral (mean pooling)",
}
METRIC_TITLES = {"accuracy": "Accuracy (%)", "precision": "Precision (%)", "recall": "Recall (%)", "f1": "F1-Score (%)"}


def box_plot_stats(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Quartiles (linear), whiskers at the last values within 1.5 interquartile ranges, fliers beyond, mean; of finite values."""
    joined = _beside_quartiles(df, value, by)
    inside = (F.col("_v") >= F.col("q1") - _reach()) & (F.col("_v") <= F.col("q3") + _reach())
    return joined.groupBy(*by, "n_rows", "mean", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.count_if(~inside).alias("n_fliers")
    )


def fliers(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """The values beyond the whiskers: those that are no further than 1.5 interquartile ranges are within."""
    joined = _beside_quartiles(df, value, by)
    return joined.filter((F.col("_v") < F.col("q1") - _reach()) | (F.col("_v") > F.col("q3") + _reach())).select(*by, F.col("_v").alias("value"))


def _reach() -> Column:
    return 1.5 * (F.col("q3") - F.col("q1"))


def _beside_quartiles(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """(by, _v and its class's n_rows, mean, q1, median, q3) of the finite values."""
    values = durable(df.select(*by, value.cast("double").alias("_v")).filter(F.abs("_v") < F.lit(float("inf"))))
    q1, q2, q3 = (F.element_at("quantiles", k) for k in (1, 2, 3))
    quartiles = exact_quantiles(values, by, (0.25, 0.5, 0.75)).select(*by, "n_rows", "mean", q1.alias("q1"), q2.alias("median"), q3.alias("q3"))
    return values.join(sent(durable(quartiles)), list(by))


def shared_folds(series: DataFrame, least: int = 1) -> DataFrame:
    """Rows (method, fold from 0, value) of the folds that every method has; methods under ``least`` folds go."""
    counts = series.groupBy("method").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    ranked = series.withColumn("_at", F.row_number().over(Window.partitionBy("method").orderBy("fold")) - 1)
    shortest = counts.agg(F.min("_n").alias("_least"))
    rows = ranked.join(counts.select("method"), "method").crossJoin(F.broadcast(shortest))
    return rows.filter(F.col("_at") < F.col("_least")).select("method", F.col("_at").alias("fold"), "value")


def friedman(series: DataFrame) -> DataFrame:
    """One row: methods k, folds n and the tie-corrected statistic over (method, fold, value)."""
    by_fold = Window.partitionBy("fold")
    same = F.count("*").over(Window.partitionBy("fold", "value"))
    rank = F.rank().over(by_fold.orderBy("value")) + (same - 1) / 2.0
    ranks = shared_folds(series).select("method", "fold", rank.alias("r"), (same * same - 1).alias("t"))
    sums = ranks.groupBy("method").agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.count("*").alias("n"))
    total = sums.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"), F.sum("t").alias("t"))
    k, n = F.col("k"), F.col("n")
    plain = 12.0 / (n * k * (k + 1)) * F.col("s") - 3.0 * n * (k + 1)
    ties = 1.0 - F.col("t") / (n * (k * k * k - k))
    return total.select("k", "n", F.when(ties > 0, plain / ties).alias("statistic"))


def chi_squared_tail(x: float, freedom: int) -> float:
    """P(chi-squared >= x), by the series or the continued fraction of the incomplete gamma function."""
    a, x = freedom / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def friedman_text(series: DataFrame) -> str:
    """"Friedman p = 0.123"; empty where fewer than three methods or no statistic make a test impossible."""
    row = friedman(series).first()
    if row is None or row["k"] < 3 or row["statistic"] is None:
        return ""
    return f"Friedman p = {chi_squared_tail(row['statistic'], row['k'] - 1):.3f}"


def method_rank(method: Column) -> Column:
    """Sort key: the fixed order first, all others after it."""
    at = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), F.lower(F.trim(method)))
    return F.when(at > 0, at).otherwise(len(METHOD_ORDER) + 1)


def display_name(method: Column) -> Column:
    key = F.lower(F.trim(method))
    out = key
    for name, said in DISPLAY_NAMES.items():
        out = F.when(key == name, F.lit(said)).otherwise(out)
    return out


def mean_and_deviation(mean: Column, deviation: Column, *, scale: float = 100.0, digits: int = 2) -> Column:
    """"mm.mm ± ss.ss"; empty if either is missing."""
    text = F.format_string(f"%.{digits}f ± %.{digits}f", mean * scale, deviation * scale)
    return F.when(mean.isNull() | deviation.isNull(), F.lit("")).otherwise(text)


def results_table(summaries: DataFrame) -> DataFrame:
    """Model and a formatted column for each metric, in the methods' order."""
    columns = [mean_and_deviation(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(title) for m, title in METRIC_TITLES.items()]
    return summaries.orderBy(method_rank(F.col("method")), "method").select(display_name(F.col("method")).alias("Model"), *columns)


def to_latex(table: DataFrame) -> str:
    """A tabular of a small table, unescaped."""
    rows = [" & ".join("" if v is None else str(v) for v in r) + r" \\" for r in table.collect()]
    head = " & ".join(table.columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", ""])


def fold_series(fold_metrics: DataFrame, metric: str) -> DataFrame:
    """(method, fold, value) in per cent."""
    return fold_metrics.filter(F.col(metric).isNotNull()).select("method", "fold", (F.col(metric) * 100).alias("value"))


def decision_grid(model, scores: DataFrame, *, side: int = 280, margin: float = 0.05) -> DataFrame:
    """(x, y, p1) on a square grid over the scores' range: where p1 passes 0.5 is the boundary."""
    from pyspark.ml.functions import vector_to_array

    from loomtext.operators.features import to_vector

    s = [F.element_at("scores", k) for k in (1, 2)]
    r = scores.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(s) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spark = scores.sparkSession
    axis = lambda k, c: F.lit(r[f"lo{k}"] - margin * (w := r[f"hi{k}"] - r[f"lo{k}"])) + c * (w * (1 + 2 * margin) / (side - 1))
    cells = spark.range(side * side)
    grid = cells.select(axis(0, (F.col("id") % side)).alias("x"), axis(1, F.floor(F.col("id") / side)).alias("y"))
    scored = model.transform(grid.withColumn("features", to_vector(F.array("x", "y"))))
    return scored.select("x", "y", F.element_at(vector_to_array("probability"), 2).alias("p1"))
