"""Transcript segments of subjects: speakers, silence, order, text; and joins of subjects with their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.labels import speaker
from loomtext.functions.text import present, strip
from loomtext.operators.corpus import require_columns

#: Speakers or texts that mean silence.
SILENCE = ("sil", "sp")


def filter_segments(
    df: DataFrame, *, keep_speakers: Sequence[str] | None = None, drop_silence: bool = True, speaker_col: str = "speaker", value_col: str = "value"
) -> DataFrame:
    """Segments of the speakers wanted, without silence and blank texts."""
    require_columns(df, [value_col, *([speaker_col] if keep_speakers else [])], "segments")
    if keep_speakers:
        names = [n.strip().strip("<>").strip() for n in keep_speakers]
        df = df.filter(speaker(F.col(speaker_col)).isin(*names))
    value = strip(present(F.col(value_col)))
    if drop_silence:
        if speaker_col in df.columns:
            df = df.filter(~F.lower(speaker(F.col(speaker_col))).isin(*SILENCE))
        df = df.filter(~F.lower(value).isin(*SILENCE))
    return df.filter(value != "")


def segments_to_text(
    df: DataFrame, *, order_by: str | None = "no", subject_col: str = "uid", value_col: str = "value", line_col: str = "seq"
) -> DataFrame:
    """(subject, text): values joined by a space, ordered by a number (unreadable ones last), then by line."""
    key: Column = F.lit(None).cast("double")
    if order_by:
        require_columns(df, [order_by], "segments")
        key = F.expr(f"try_cast(`{order_by}` AS double)")
    part = F.struct(F.isnull(key).alias("last"), key.alias("key"), F.col(line_col).alias("line"), strip(F.col(value_col)).alias("value"))
    grouped = df.groupBy(subject_col).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(subject_col, F.array_join(F.transform("parts", lambda p: p["value"]), " ").alias("text"))


def subjects_with_text(subjects: DataFrame, segments: DataFrame, texts: DataFrame, subject_col: str = "uid") -> DataFrame:
    """Subjects that have a file, with their text; a file of which nothing is left gives an empty text."""
    files = segments.select(subject_col).distinct()
    found = subjects.join(files, subject_col, "left_semi").join(texts, subject_col, "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def subjects_without_file(subjects: DataFrame, segments: DataFrame, subject_col: str = "uid") -> DataFrame:
    return subjects.join(segments.select(subject_col).distinct(), subject_col, "left_anti")


def join_features(subjects: DataFrame, features: DataFrame, *, id_col: str = "uuid", label_col: str = "Diagnosis", extras: Sequence[str] = ("sex", "age", "education")) -> DataFrame:
    """Subjects with features: id, label, the extras there are, then all features. Clashing names are an error."""
    clash = sorted(set(subjects.columns) & set(features.columns) - {id_col})
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    own = [c for c in (label_col, *extras) if c in subjects.columns]
    return subjects.join(features, id_col).select(id_col, *own, *[c for c in features.columns if c != id_col])
