"""From corpora to the cleaned corpus: one lazy plan from the scans to the sink."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.prompts import drop_prompts_twice
from loomtext.functions.text import clean_transcript, computed_once
from loomtext.operators import corpus as c
from loomtext.operators.quality import QualityLimits, length_filter, quality_filter
from loomtext.operators.ranking import numbered
from loomtext.operators.sampling import sample_classes
from loomtext.plans.config import names, require, sampling, section
from loomtext.session import durable
from loomtext.sources.files import file_exists
from loomtext.sources.readers import csv_table, json_lines
from loomtext.sources.writers import write_json_lines

KEYS = (c.DATASET, c.ID)
log = logging.getLogger(__name__)


def transcripts_to_corpus(spark: SparkSession, asr: Mapping, text: Mapping, *, force: bool = False, dataset: str = "NCMMSC2021_AD_Competition") -> None:
    """Step 0: the recogniser's table as JSON lines; what is there already stays unless forced."""
    target = text.get("ncmmsc_jsonl")
    if target:
        rows = csv_table(spark, require(asr, "output_csv", "asr."))
        c.require_columns(rows, ["id", "label", "transcript"], "transcripts")
        write_json_lines(c.normalise_schema(rows, dataset).select(c.ID, c.LABEL, c.TEXT, c.DATASET, c.LANGUAGE), target, order=KEYS, force=force)


def united(spark: SparkSession, text: Mapping, *, skip_missing: bool | None = None) -> DataFrame:
    """Steps 1 and 2: the configured corpora that are wanted, in order.

    A missing file is an error unless it is to be skipped: by the argument, or else by ``skip_missing_corpora``.
    """
    skip_missing = bool(text.get("skip_missing_corpora", False)) if skip_missing is None else skip_missing
    listed, targets = require(text, "corpora", "text.", list), names(text.get("target_datasets"))
    corpora = []
    for own in listed:
        name, path = own.get("name"), own.get("path")
        if not name or not path or (targets is not None and name not in targets):
            continue
        if skip_missing and not file_exists(path):
            log.warning("corpus %s: %s is missing", name, path)
            continue
        corpora.append((name, json_lines(spark, path, ordered=True)))
    return c.union_corpora(corpora, targets)


def prompt_options(text: Mapping) -> dict | None:
    own = text.get("prompt_filter") or {}
    if not own.get("enabled", False):
        return None
    return {
        "patterns": own.get("patterns") or [],
        "echo_patterns": own.get("echo_patterns") or [],
        "echo": own.get("echo_enabled", True),
        "apply_to": names(own.get("apply_datasets")),
        "mode": own.get("mode", "leading"),
        "most_leading": int(own.get("max_leading_sentences", 8)),
        "least_kept": int(own.get("min_keep_chars", 20)),
    }


def cleaned(records: DataFrame, text: Mapping) -> DataFrame:
    """Dedup, labels, languages, subset, cleaning, prompts, quality, drawn subset, length: in this order.

    Classes are drawn after the quality filter and before the length filter, so they may end below the cap.
    """
    df = c.map_labels(c.dedup_records(records), text.get("label_map"))
    df = c.drop_languages(df, section(text, "language_filter").get("drop_languages") or [])
    datasets, labels = names(text.get("target_datasets")), names(text.get("target_labels"))
    df = c.assert_known_labels(c.restrict(df, datasets, labels))
    df = computed_once(df, {c.TEXT: clean_transcript(F.col(c.TEXT))})
    if options := prompt_options(text):
        df = computed_once(df, {c.TEXT: drop_prompts_twice(F.col(c.TEXT), F.col(c.DATASET), **options)})
    quality = text.get("quality_filter") or {}
    if quality.get("enabled", True):
        limits = QualityLimits(int(quality.get("min_chars", 15)), int(quality.get("min_lex_chars", 8)), int(quality.get("min_han", 6)), float(quality.get("max_unk_ratio", 0.75)))
        df = quality_filter(df, c.TEXT, limits)
    # what follows reads the rows several times: class sizes, ranks, length statistics
    df = durable(df)
    draw = sampling(text)
    df = c.assert_known_labels(_drawn(df, draw))
    length = text.get("length_filter") or {}
    if length.get("enabled", True):
        df = length_filter(df, c.TEXT, c.LABEL, float(require(length, "std_k", "length_filter.")), int(length.get("min_class_n", 30)))
    if text.get("post_length_subset", False):
        df = _drawn(df, draw)
    return df


def _drawn(df: DataFrame, draw: Mapping) -> DataFrame:
    if draw["seed"] is None:
        return df
    return sample_classes(df, seed=draw["seed"], keys=KEYS, label_col=c.LABEL, cap=draw["cap"], balance=draw["balance"])


def run_text(
    spark: SparkSession, config: Mapping, *, force_transcripts: bool = False, skip_transcripts: bool = False, skip_missing: bool | None = None
) -> str:
    """All steps; the cleaned corpus as JSON lines. Returns its path."""
    text = section(config, "text")
    if not skip_transcripts and text.get("ncmmsc_jsonl"):
        transcripts_to_corpus(spark, section(config, "asr"), text, force=force_transcripts)
    records = united(spark, text, skip_missing=skip_missing)
    combined = f"{require(text, 'output_dir', 'text.')}/{require(text, 'combined_name', 'text.')}"
    write_json_lines(c.stable_sort(records).drop(c.SOURCE_AT, c.LINE_AT), combined)
    out = cleaned(records, text)
    target = require(text, "cleaned_jsonl", "text.")
    write_json_lines(c.stable_sort(out).drop(c.SOURCE_AT, c.LINE_AT), target)
    return target


def cleaned_view(corpus: DataFrame, order: Sequence[str] = KEYS) -> DataFrame:
    """(row_id, text, y) of a cleaned corpus: HC 0, AD 1, others left out; row ids follow the order."""
    from loomtext.functions.labels import binary
    from loomtext.functions.text import present

    c.require_columns(corpus, [c.TEXT, c.LABEL], "cleaned corpus")
    rows = c.binary_only(corpus)
    keys = [o for o in (*order, c.LINE_AT) if o in corpus.columns] or [c.TEXT, c.LABEL]
    return numbered(rows, keys).select("row_id", present(F.col(c.TEXT)).alias("text"), binary(F.col(c.LABEL)).alias("y"))
