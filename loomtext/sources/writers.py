"""Sinks: transcripts, JSON lines, feature tables, folds and metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import present, strip
from loomtext.sources.files import file_exists, write_text

# Columns of the transcript table, and of its older form.
TRANSCRIPT_COLUMNS = ("id", "label", "transcript", "audio_path", "duration")
OLDER_COLUMNS = ("id", "label", "transcript", "cleaned_transcript", "audio_path", "duration")
#: Rows whose indices a folds document lists itself, at most; more are a table whose name ends like this.
MOST_FOLD_ROWS, FOLDS_TABLE = 2_000_000, ".rows"


def transcript_rows(df: DataFrame, cleaner: Callable[[Column], Column] | None = None, *, older: bool = False, nulls: bool = False) -> DataFrame:
    """Null texts empty, id and label stripped, unreadable durations 0; the older form has a cleaned text too.

    With ``nulls`` what is null stays null, also the cleaned text of a null one; CSV says it without quotes.
    """

    def own(name: str, value: Column) -> Column:
        return F.when(F.col(name).isNotNull(), value) if nulls else value

    out = df.select(
        own("id", strip(present(F.col("id")))).alias("id"),
        own("label", strip(present(F.col("label")))).alias("label"),
        own("transcript", present(F.col("transcript"))).alias("transcript"),
        own("transcript", cleaner(present(F.col("transcript"))) if cleaner else F.lit("")).alias("cleaned_transcript"),
        own("audio_path", present(F.col("audio_path"))).alias("audio_path"),
        own("duration", F.coalesce(F.col("duration").cast("string").try_cast("double"), F.lit(0.0))).alias("duration"),
    )
    return out.select(*(OLDER_COLUMNS if older else TRANSCRIPT_COLUMNS))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, *, one_file: bool = False, mark: bool = False) -> None:
    """CSV with a header; ``mark`` puts a byte order mark before the first name, for spreadsheets."""
    df = df.select(*columns) if columns else df
    if mark:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_lines(df: DataFrame, path: str, *, order: Sequence[str] = (), one_file: bool = False, force: bool = True) -> None:
    """JSON lines with explicit nulls, unescaped; ``force=False`` leaves what is there alone."""
    df = df.orderBy(*order) if order else df
    (df.coalesce(1) if one_file else df).write.mode("overwrite" if force else "ignore").option("ignoreNullFields", False).json(path)


def combine_json_lines(spark: SparkSession, inputs: Sequence[str], path: str) -> None:
    """All records of the inputs, by path and line, as one set of JSON lines; no inputs or a missing one is an error."""
    from loomtext.sources.readers import checked_json_lines

    if not inputs:
        raise ValueError("no inputs")
    for name in inputs:
        if not file_exists(name):
            raise FileNotFoundError(name)
    checked_json_lines(spark, sorted(inputs)).orderBy("path", "number").select("record").write.mode("overwrite").text(path)


def write_folds(folded: DataFrame, path: str, *, id_col: str = "row_id", n_splits: int, most: int = MOST_FOLD_ROWS) -> None:
    """Folds as index lists in one JSON document. Beyond ``most`` rows the document names a table of (row_id, fold) beside
    it instead, which ``readers.folds`` reads like the lists; ``folded`` is read twice."""
    rows = folded.select(F.col(id_col).alias("row_id"), "fold")
    if rows.limit(most + 1).count() > most:
        rows.write.mode("overwrite").parquet(f"{path}{FOLDS_TABLE}")
        write_document({"n_splits": n_splits, "table": f"{path.rsplit('/', 1)[-1]}{FOLDS_TABLE}"}, path)
        return
    table = rows.orderBy("row_id").toArrow()
    ids, fold = table.column("row_id").to_numpy(), table.column("fold").to_numpy()
    write_document([{"train_idx": ids[fold != k].tolist(), "test_idx": ids[fold == k].tolist()} for k in range(n_splits)], path)


def check_folds(folds: DataFrame, rows: DataFrame, *, id_col: str = "row_id") -> None:
    """An error if saved folds don't hold exactly the rows there are."""
    saved = folds.filter("is_test").select(F.col("row_id").alias(id_col))
    here = rows.select(id_col)
    if not saved.exceptAll(here).isEmpty() or not here.exceptAll(saved).isEmpty():
        raise ValueError("the saved folds belong to other rows")


def write_document(document: object, path: str) -> None:
    write_text(path, json.dumps(document, ensure_ascii=False, indent=2))
