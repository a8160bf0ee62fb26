"""The report of a cleaned corpus and a metrics document: tables, and the data of every plot."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import corpus as c
from loomtext.operators import model as m
from loomtext.operators import report as r
from loomtext.operators.features import fit_tfidf, to_vector, truncated_svd
from loomtext.operators.ranking import numbered
from loomtext.plans.config import require, section
from loomtext.plans.crossval import vectoriser_options
from loomtext.session import durable
from loomtext.sources.files import file_exists, write_text
from loomtext.sources.readers import json_lines, metrics_runs, texts_and_labels
from loomtext.sources.writers import write_csv, write_document

log = logging.getLogger(__name__)


def fold_metrics(spark: SparkSession, document: Mapping) -> DataFrame:
    """(method, fold and metrics) of the methods that have folds."""
    rows = [(name, f["fold"], *[float(f[x]) for x in m.METRICS]) for name, own in document["methods"].items() for f in own.get("fold_metrics") or []]
    return spark.createDataFrame(rows, "method string, fold int, accuracy double, precision double, recall double, f1 double")


def fold_metrics_of(runs: DataFrame) -> DataFrame:
    """(run, method, fold and metrics) of ``readers.metrics_runs``, a column for each metric of the tables."""
    columns = [F.max(F.when(F.col("metric") == x, F.col("value"))).alias(x) for x in m.METRICS]
    return runs.groupBy("run", "method", "fold").agg(*columns)


def run_report(
    spark: SparkSession, config: Mapping, outdir: str, *, boundary: bool = False, boundary_scope: str = "cleaned", skip_combined: bool = False
) -> None:
    """Length distributions and 2-D scores of the cleaned and the combined corpus, then the metrics' tables.

    The boundary is drawn in the cleaned corpus, or in ``both``. What fails for the combined corpus, or isn't there, is left out with a
    warning, and so are the metrics where there is no document yet.
    """
    if boundary_scope not in ("cleaned", "both"):
        raise ValueError(f"unknown boundary scope: {boundary_scope}")
    text, features = section(config, "text"), section(config, "features")
    corpus_report(spark, features, "cleaned", require(text, "cleaned_jsonl", "text."), outdir, boundary)
    combined = f"{require(text, 'output_dir', 'text.')}/{require(text, 'combined_name', 'text.')}"
    if not skip_combined and file_exists(combined):
        try:
            corpus_report(spark, features, "combined", combined, outdir, boundary and boundary_scope == "both")
        except Exception as error:  # a corpus before cleaning may lack anything
            log.warning("the combined corpus is left out: %s", error)
    metrics = require(section(features, "crossval"), "metrics_output", "crossval.")
    if not file_exists(metrics):
        log.warning("no metrics yet: %s", metrics)
        return
    metrics_report(durable(fold_metrics_of(metrics_runs(spark, metrics)).drop("run")), outdir)


def metrics_report(by_fold: DataFrame, outdir: str) -> None:
    """results_table (CSV and LaTeX), box plots, fold lines and Friedman texts; a row for each method and fold is small."""
    table = r.results_table(m.summary(by_fold, ["method"]))
    write_csv(table, f"{outdir}/results_table", one_file=True)
    write_text(f"{outdir}/results_table.tex", r.to_latex(table))
    texts = {}
    every = r.fold_series(by_fold, m.METRICS[0]).withColumn("metric", F.lit(m.METRICS[0]))
    for metric in m.METRICS[1:]:
        every = every.unionByName(r.fold_series(by_fold, metric).withColumn("metric", F.lit(metric)))
    boxes = durable(r.box_plot_stats(every, F.col("value"), ["metric", "method"]))
    for metric in m.METRICS:
        series = r.fold_series(by_fold, metric)
        write_csv(boxes.filter(F.col("metric") == metric).drop("metric"), f"{outdir}/{metric}_boxplot", one_file=True)
        write_csv(r.shared_folds(series, 2).orderBy("method", "fold"), f"{outdir}/{metric}_folds", one_file=True)
        texts[metric] = r.friedman_text(series)
    write_document(texts, f"{outdir}/friedman.json")


def corpus_report(spark: SparkSession, features: Mapping, name: str, path: str, outdir: str, boundary: bool) -> None:
    """Lengths by label, the two leading components of TF-IDF, and where a classifier over them draws its boundary."""
    rows = texts_and_labels(json_lines(spark, path, ordered=True), keep=[c.LINE_AT])
    rows = durable(numbered(rows, [c.LINE_AT], "id").drop(c.LINE_AT))
    write_csv(r.box_plot_stats(rows, F.length("text"), ["label"]), f"{outdir}/{name}_lengths", one_file=True)
    vectors = durable(fit_tfidf(rows, "text", **vectoriser_options(section(features, "tfidf"))).transform(rows, "text"))
    scores, shares = truncated_svd(vectors, "id")
    placed = durable(rows.select("id", "label", "y").join(scores, "id"))
    write_csv(placed.select("label", *[F.element_at("scores", k).alias(f"c{k}") for k in (1, 2)]), f"{outdir}/{name}_2d")
    write_document({"explained_variance_ratio": shares}, f"{outdir}/{name}_2d.json")
    if boundary:
        model = m.fit_logistic(placed.withColumn("features", to_vector(F.col("scores"))))
        write_csv(r.decision_grid(model, placed.select("scores")), f"{outdir}/{name}_boundary")
