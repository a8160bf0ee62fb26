"""Subjects with a transcript file and acoustic features: a text corpus and a feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.labels import canonical_strict
from loomtext.operators import corpus as c
from loomtext.operators import segments as s
from loomtext.plans.config import names, require, section
from loomtext.sources.readers import csv_table, tsv_segments
from loomtext.sources.writers import write_csv, write_json_lines

EXTRAS = ("sex", "age", "education")


def subjects(meta: DataFrame) -> DataFrame:
    """One row for each valid uuid, the first in the file, with a canonical label."""
    c.require_columns(meta, ["uuid", "label"], "meta table")
    rows = c.dedup_subjects(meta, "uuid", file_order(meta))
    return rows.withColumn(c.LABEL, canonical_strict(F.col("label"))).drop(c.LINE_AT, "label")


def file_order(df: DataFrame) -> list[str]:
    """The line's place in its file, where the scan kept it; else the columns' values."""
    return [c.LINE_AT] if c.LINE_AT in df.columns else sorted(df.columns)


def feature_rows(features: DataFrame) -> DataFrame:
    c.require_columns(features, ["uuid"], "feature table")
    return c.dedup_subjects(features, "uuid", file_order(features)).drop(c.LINE_AT)


def text_corpus(meta: DataFrame, segments: DataFrame, options: Mapping, dataset: str) -> DataFrame:
    """A record for each subject that has a file, with an empty text if nothing of it is left."""
    people = meta.withColumnRenamed("uuid", "uid")
    kept = s.filter_segments(segments, keep_speakers=options.get("keep_speakers"), drop_silence=options.get("drop_silence", True))
    texts = s.segments_to_text(kept, order_by=options.get("order_by"))
    found = s.subjects_with_text(people, segments, texts)
    extras = [F.col(x) if x in found.columns else F.lit(None).cast("string").alias(x) for x in EXTRAS]
    return found.select(F.col("uid").alias(c.ID), c.LABEL, F.col("text").alias(c.TEXT), F.lit(dataset).alias(c.DATASET), F.lit("zh").alias(c.LANGUAGE), *extras)


def run_predictive(spark: SparkSession, config: Mapping) -> tuple[str, str]:
    own = section(config, "predictive")
    tsv = require(own, "tsv", "predictive.", dict)
    options = {
        "keep_speakers": names(tsv.get("keep_speakers") or own.get("keep_speakers")),
        "drop_silence": tsv.get("drop_silence", True),
        "order_by": tsv.get("order_by"),
    }
    meta = subjects(csv_table(spark, require(own, "meta_csv", "predictive."), ordered=True))
    features = feature_rows(csv_table(spark, require(own, "egemaps_csv", "predictive."), infer=True, ordered=True))
    segments = tsv_segments(spark, require(own, "tsv_root", "predictive."))
    texts, table = require(own, "output_text_jsonl", "predictive."), require(own, "output_egemaps_csv", "predictive.")
    dataset = own.get("dataset_name", "Chinese_predictive_challenge")
    write_json_lines(text_corpus(meta, segments, options, dataset), texts, order=(c.ID,))
    write_csv(s.join_features(meta, features).orderBy("uuid"), table, mark=True)
    return texts, table
