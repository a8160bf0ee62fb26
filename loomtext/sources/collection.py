"""Extension point: a corpus that says how its raw records become normalised ones."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Fields of a normalised record; Task is a list, all others are text.
FIELDS = (
    "PID Languages MMSE Diagnosis Participants Dataset Modality Task File_ID Media Age Gender Education Source Continents Countries Duration "
    "Location Date Transcriber Moca Setting Comment Text_interviewer_participant Text_participant Text_interviewer"
).split()
NORMALISED = StructType([StructField(n, ArrayType(StringType()) if n == "Task" else StringType()) for n in FIELDS])


class Collection(ABC):
    """A corpus at a path. Subclasses read it and map its columns; the rest is filled with nulls."""

    def __init__(self, path: str, language: str):
        self.path, self.language = path, language

    @abstractmethod
    def raw(self, spark: SparkSession) -> DataFrame:
        """The records as they are."""

    @abstractmethod
    def normalise(self, raw: DataFrame) -> DataFrame:
        """Columns of FIELDS, as far as the corpus has them."""

    def normalised(self, spark: SparkSession) -> DataFrame:
        df = self.normalise(self.raw(spark))
        if unknown := sorted(set(df.columns) - set(FIELDS)):
            raise ValueError(f"not fields of a normalised record: {unknown}")
        have = set(df.columns)
        filled = {f.name: F.col(f.name) if f.name in have else F.lit(self.language if f.name == "Languages" else None) for f in NORMALISED}
        return df.select(*[c.cast(NORMALISED[n].dataType).alias(n) for n, c in filled.items()])
