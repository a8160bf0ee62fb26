"""Text quality and length outliers, as expressions and one grouped aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import HAN, SOLID, UNK, WS, computed_once, marked, present, strip

#: Markers that aren't words, and what each of them begins with.
MARKERS = rf"{UNK}|\[//\]|\[/\]|\[\+{WS}*gram\]|<\.\.\.>|&-(?:uh|um)"
MARKS = (UNK, "[/", "[+", "<...>", "&-u")


@dataclass(frozen=True)
class QualityLimits:
    """Fixed default values; ``script`` is the class of characters that must occur."""

    least_chars: int = 15
    least_lexical: int = 8
    least_script: int = 6
    most_unknown: float = 0.75
    script: str = HAN


def quality_metrics(text: Column, lexical: Column, limits: QualityLimits = QualityLimits()) -> dict[str, Column]:
    """total_len, lex_len, script_len and unk_ratio of a stripped text and of the same without markers."""
    unknown = F.when(F.contains(text, F.lit(UNK)), F.regexp_count(text, F.lit(UNK))).otherwise(0)
    return {
        "total_len": F.length(text),
        "lex_len": F.length(F.regexp_replace(lexical, rf"(?U)[[^{SOLID}]&&{WS}]+", "")),
        "script_len": F.regexp_count(lexical, F.lit(limits.script)),
        "unk_ratio": unknown * F.lit(float(len(UNK))) / F.greatest(F.length(text), F.lit(1)),
    }


def with_quality(df: DataFrame, text_col: str, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The metrics as columns; what several of them stand on, the stripped text and the one without markers, is computed once."""
    whole = computed_once(df, {"_whole": strip(present(F.col(text_col)))})
    whole = computed_once(whole, {"_lexical": marked(F.col("_whole"), MARKS, (MARKERS, ""))})
    return computed_once(whole, quality_metrics(F.col("_whole"), F.col("_lexical"), limits)).drop("_whole", "_lexical")


def drop_reasons(limits: QualityLimits) -> dict[str, Column]:
    """Conditions on the metric columns; a text may meet several."""
    return {
        "short": F.col("total_len") < limits.least_chars,
        "low_lexical": F.col("lex_len") < limits.least_lexical,
        "low_script": F.col("script_len") < limits.least_script,
        "high_unknown": F.col("unk_ratio") > limits.most_unknown,
    }


def quality_filter(df: DataFrame, text_col: str, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Rows that no reason drops, with the columns that came in."""
    kept = with_quality(df.withColumn("_in", F.struct("*")), text_col, limits)
    for reason in drop_reasons(limits).values():
        kept = kept.filter(~reason)
    return kept.select("_in.*")


def drop_counters(df: DataFrame, text_col: str, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row: rows before and after, and how many each reason applies to."""
    reasons = drop_reasons(limits)
    any_reason = F.lit(False)
    for reason in reasons.values():
        any_reason = any_reason | reason
    measured = with_quality(df.select(text_col), text_col, limits)
    return measured.agg(
        F.count("*").alias("n_before"),
        F.count_if(~any_reason).alias("n_after"),
        *[F.count_if(c).alias(f"n_{name}") for name, c in reasons.items()],
    )


def _size(text: str | Column) -> Column:
    return text if isinstance(text, Column) else F.length(present(F.col(text)))


def length_stats(df: DataFrame, text_col: str | Column, label_col: str) -> DataFrame:
    """Per class: rows, least, most and mean length, and the sample deviation (0 for a single row).

    A Column in place of the text's name is its length, for rows that left their text where it was read.
    """
    size = _size(text_col)
    return df.groupBy(label_col).agg(
        F.count("*").alias("n_rows"),
        F.min(size).alias("min_len"),
        F.max(size).alias("max_len"),
        F.avg(size).alias("mean_len"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std_len"),
    )


def length_filter(df: DataFrame, text_col: str | Column, label_col: str, k: float, least_class: int = 30) -> DataFrame:
    """Rows within ``k`` deviations of their class's mean length; all rows if a class has under ``least_class``.

    The guard is part of the plan: classes are few, so their statistics, with the smallest class, are broadcast.
    ``df`` is read twice, for the statistics and for the rows; what is expensive in it is made durable before.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    stats = length_stats(df, text_col, label_col).select(F.col(label_col).alias("_label"), "n_rows", "mean_len", "std_len")
    # a row for each class alone passes through the unpartitioned window
    limits = stats.withColumn("_smallest", F.min("n_rows").over(Window.partitionBy(F.lit(0))))
    size = _size(text_col)
    inside = size.between(F.col("mean_len") - k * F.col("std_len"), F.col("mean_len") + k * F.col("std_len"))
    joined = df.join(F.broadcast(limits), F.col(label_col).eqNullSafe(F.col("_label")))
    return joined.filter((F.col("_smallest") < least_class) | inside).select(*df.columns)
