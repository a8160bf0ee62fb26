"""Corpus records: one schema, union in a fixed order, first-come dedup, restriction, sorting, guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.labels import UNKNOWN, mapped, subject_id
from loomtext.functions.text import present, strip

# The columns of a corpus record, and the older names that stand for three of them.
ID, LABEL, TEXT, DATASET, LANGUAGE = "ID", "Diagnosis", "Text_interviewer_participant", "Dataset", "Languages"
OLDER = {"id": ID, "label": LABEL, "transcript": TEXT}
#: Order of a record: its corpus, and its line there, as a number or as text that sorts like one (``line_ordinal`` of
#: the readers). Never left to the order of partitions.
SOURCE_AT, LINE_AT = "_source_at", "_line_at"


def require_columns(df: DataFrame, names: Sequence[str], where: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{where}: missing columns {missing}")


def normalise_schema(df: DataFrame, dataset: str, language: str = "zh") -> DataFrame:
    """Older names are taken where the newer one is missing; the five core columns are text, extras pass.

    A null or empty Dataset becomes ``dataset``, a null text empty, a null or blank language ``language``; null
    ids and labels stay null.
    """
    for old, new in OLDER.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    require_columns(df, [ID, LABEL, TEXT], f"corpus {dataset}")

    def filled(name: str, default: str, blank: bool) -> Column:
        if name not in df.columns:
            return F.lit(default)
        value = F.col(name).cast("string")
        empty = strip(present(value)) == "" if blank else present(value) == ""
        return F.when(empty, F.lit(default)).otherwise(value)

    return df.withColumns(
        {
            ID: strip(F.col(ID).cast("string")),
            LABEL: strip(F.col(LABEL).cast("string")),
            TEXT: present(F.col(TEXT)),
            DATASET: filled(DATASET, dataset, False),
            LANGUAGE: filled(LANGUAGE, language, True),
        }
    )


def union_corpora(corpora: Sequence[tuple[str, DataFrame | None]], targets: Sequence[str] | None = None) -> DataFrame:
    """All named corpora with data that are wanted, in their order; columns are matched by name, missing ones null.

    The order of records is that of LINE_AT. A corpus without it has no order of its own: its records are told apart by
    what they say.
    """
    wanted = [(n, df) for n, df in corpora if n and df is not None and (targets is None or n in targets)]
    if not wanted:
        raise ValueError("no corpus is left to be united")
    parts = []
    for k, (name, df) in enumerate(wanted):
        df = normalise_schema(df, name)
        if LINE_AT not in df.columns:
            df = df.withColumn(LINE_AT, F.to_json(F.struct(TEXT, LABEL, LANGUAGE, *sorted(set(df.columns) - {TEXT, LABEL, LANGUAGE}))))
        elif dict(df.dtypes)[LINE_AT] != "string":
            df = df.withColumn(LINE_AT, F.lpad(F.col(LINE_AT).cast("string"), 20, "0"))
        parts.append(df.withColumn(SOURCE_AT, F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; keys may be null.

    As an aggregate, so that of a frequent key's rows each task sends on one alone.
    """
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def dedup_records(df: DataFrame) -> DataFrame:
    """One record for each (Dataset, ID): that of the earliest corpus and line."""
    return keep_first(df, [DATASET, ID], [SOURCE_AT, LINE_AT])


def dedup_subjects(df: DataFrame, id_col: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows with a valid subject id, stripped, the first of each."""
    valid = df.withColumn(id_col, subject_id(F.col(id_col))).filter(F.col(id_col).isNotNull())
    return keep_first(valid, [id_col], order)


def subject_counters(df: DataFrame, id_col: str) -> DataFrame:
    """One row: how many rows dedup_subjects drops as invalid and as repeated."""
    key = subject_id(F.col(id_col))
    valid = F.count(key)
    return df.agg(
        F.count_if(key.isNull()).alias("dropped_invalid"), (valid - F.count_distinct(key)).alias("dropped_dups"), F.count("*").alias("n_rows")
    )


def map_labels(df: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn(LABEL, mapped(F.col(LABEL), table))


def drop_languages(df: DataFrame, languages: Sequence[str], column: str = LANGUAGE) -> DataFrame:
    """Without the rows in these languages (any case); nothing happens without languages or without the column."""
    names = [x.strip().lower() for x in languages or () if x and x.strip()]
    if not names or column not in df.columns:
        return df
    return df.filter(~F.lower(strip(present(F.col(column)))).isin(*names))


def restrict(
    df: DataFrame,
    datasets: Sequence[str] | None = None,
    labels: Sequence[str] | None = None,
    *,
    dataset_col: str = DATASET,
    label_col: str = LABEL,
) -> DataFrame:
    """Rows of the datasets (exact) and labels (any case) named; rows without a label always go."""
    if datasets:
        df = df.filter(strip(F.col(dataset_col)).isin(*[d.strip() for d in datasets]))
    label = F.upper(strip(present(F.col(label_col))))
    if labels:
        df = df.filter(label.isin(*[x.strip().upper() for x in labels]))
    return df.filter(label != "")


def binary_only(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Rows labelled HC or AD; it is an error if there are none."""
    out = df.filter(strip(F.col(label_col)).isin("HC", "AD"))
    if out.isEmpty():
        raise ValueError("no row is labelled HC or AD")
    return out


def non_blank(df: DataFrame, text_col: str = TEXT) -> DataFrame:
    return df.filter(strip(present(F.col(text_col))) != "")


def assert_known_labels(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """The same rows; a row with an unknown label fails the job that reads it."""
    known = F.assert_true(F.coalesce(F.col(label_col), F.lit(UNKNOWN)) != UNKNOWN, F.lit("a label is unknown"))
    return df.filter(known.isNull())


def assert_class_sizes(df: DataFrame, label_col: str, least: int) -> None:
    """An error if a class has fewer rows than ``least``."""
    small = df.groupBy(label_col).count().filter(F.col("count") < least).collect()
    if small:
        raise ValueError(f"too few rows for {least} folds: {[tuple(r) for r in small]}")


def label_distribution(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    return df.groupBy(label_col).agg(F.count("*").alias("n_rows"))


def stable_sort(df: DataFrame, *columns: str) -> DataFrame:
    """By the columns (Dataset and ID unless said), ties in the records' own order where they have one."""
    return df.orderBy(*sort_keys(df, *columns))


def sort_keys(df: DataFrame, *columns: str) -> list[str]:
    """The columns (Dataset and ID unless said) and the records' own order, as far as there is one."""
    return [*(columns or (DATASET, ID)), *(c for c in (SOURCE_AT, LINE_AT) if c in df.columns)]
