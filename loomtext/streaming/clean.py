"""The stateless part of the corpus plan over a stream: cleaning, prompts and quality, row by row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.prompts import drop_prompts_twice
from loomtext.functions.text import clean_transcript
from loomtext.operators import corpus as c
from loomtext.operators.quality import QualityLimits, quality_filter


def clean_stream(
    records: DataFrame, *, label_map: Mapping[str, str] | None = None, prompts: Mapping | None = None, limits: QualityLimits | None = QualityLimits(), parts: int | None = None
) -> DataFrame:
    """Works on a streaming and on a static frame alike; sampling, length and TF-IDF need all rows and are batch only.

    ``parts`` deals each batch out evenly before it is cleaned, which costs far more than moving it: a scan has no more
    tasks with rows than its files have row groups, often one.
    """
    records = records.repartition(parts) if parts else records
    df = c.map_labels(records, dict(label_map or {})).withColumn(c.TEXT, clean_transcript(F.col(c.TEXT)))
    if prompts:
        df = df.withColumn(c.TEXT, drop_prompts_twice(F.col(c.TEXT), F.col(c.DATASET), **prompts))
    return quality_filter(df, c.TEXT, limits) if limits else df
