"""Interviewer prompts in transcripts: sentences that match are dropped, at the start or anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import WS, present, squeeze, strip

#: Fixed value: a sentence ends after one of these.
SENTENCE_BREAK = rf"(?U)(?<=[。！？!?；;，,、\n]){WS}*"


def usable_patterns(patterns: Sequence[str] | None) -> list[str]:
    """The patterns that the JVM compiles; others are left out, as their owner can't know the engine."""
    jvm, out = SparkSession.getActiveSession()._jvm, []
    for pattern in patterns or ():
        try:
            jvm.java.util.regex.Pattern.compile("(?U)" + pattern)
        except (IllegalArgumentException, Py4JJavaError):
            continue
        out.append("(?U)" + pattern)
    return out


def drop_prompts(
    text: Column,
    patterns: Sequence[str] | None,
    *,
    enabled: bool = True,
    mode: str = "leading",
    most_leading: int = 8,
    least_kept: int = 20,
) -> Column:
    """``leading`` drops matching sentences at the start, up to ``most_leading``; ``any`` drops all that match.

    A result shorter than ``least_kept`` becomes empty. Without a usable pattern the text is only squeezed.
    """
    text = present(text)
    if not enabled:
        return strip(text)
    usable = usable_patterns(patterns)
    text = squeeze(text)
    if not usable:
        return text
    sentences = F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != "")

    def is_prompt(sentence: Column) -> Column:
        found = sentence.rlike(usable[0])
        for pattern in usable[1:]:
            found = found | sentence.rlike(pattern)
        return found

    if mode.strip().lower() == "any":
        kept = F.filter(sentences, lambda s: ~is_prompt(s))
    else:
        first_other = F.array_position(F.transform(sentences, is_prompt), False)
        leading = F.when(first_other == 0, F.size(sentences)).otherwise(first_other - 1)
        start = F.least(leading, F.lit(max(0, most_leading)).cast("long")).cast("int")
        kept = F.slice(sentences, start + 1, F.size(sentences))
    out = squeeze(F.array_join(kept, " "))
    return F.when(F.length(out) < least_kept, F.lit("")).otherwise(out)


def drop_prompts_twice(
    text: Column,
    dataset: Column | None,
    patterns: Sequence[str],
    echo_patterns: Sequence[str] = (),
    *,
    echo: bool = True,
    apply_to: Sequence[str] | None = None,
    mode: str = "leading",
    most_leading: int = 8,
    least_kept: int = 20,
) -> Column:
    """Prompts, then echoes of the recogniser's own instruction anywhere; only for the named datasets, if any are."""
    out = drop_prompts(text, patterns, mode=mode, most_leading=most_leading, least_kept=least_kept)
    if echo and echo_patterns:
        out = drop_prompts(out, echo_patterns, mode="any", least_kept=least_kept)
    if apply_to:
        return F.when(strip(dataset).isin(*apply_to), out).otherwise(present(text))
    return out


def prompt_stats(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: texts, how many changed, how many became empty, mean loss of characters."""
    a, b = present(F.col(before)), present(F.col(after))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(a != b).alias("n_changed"),
        F.count_if((a != "") & (b == "")).alias("n_emptied"),
        F.avg(F.length(a) - F.length(b)).alias("mean_chars_lost"),
    )
