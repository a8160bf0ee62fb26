"""Scans: audio trees, CSV, TSV folders, JSON lines, word vectors, folds and metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.functions.labels import sample_id
from loomtext.functions.text import present, strip
from loomtext.sources.files import read_text

# Label folders in order, kinds of audio files, text columns in order of preference.
AUDIO_LABELS = ("AD", "HC", "MCI")
AUDIO_KINDS = ("wav", "mp3", "flac", "m4a", "ogg")
TEXT_COLUMNS = ("Text_interviewer_participant", "text", "Text", "utterance", "sentence")
#: Fixed value: columns of Spark's scan of whole files.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Tasks of a scan up to which what is known of its splits is broadcast.
FEW_TASKS = 1000


def _path_part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def audio_files(files: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(label, id, audio_path) of those of a scan of files (a stream or not) that are audio in a label's folder."""
    wanted = [x.strip().upper() for x in labels or AUDIO_LABELS]
    name = F.url_decode(_path_part(F.col("path"), 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    rows = files.select(_path_part(F.col("path"), 2).alias("label"), stem.alias("stem"), kind.alias("kind"), F.col("path").alias("audio_path"))
    rows = rows.filter(F.col("label").isin(*wanted) & F.col("kind").isin(*AUDIO_KINDS))
    return rows.select("label", sample_id(F.col("label"), F.col("stem")).alias("id"), "audio_path")


def audio_tree(spark: SparkSession, root: str, labels: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """(label, id, audio_path) of the audio files in the label folders, by name; contents aren't read.

    Folders that aren't there are left out; ``cap`` keeps the first files of each label. Spark's listing skips names
    that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root).select("path")
    rows = audio_files(files, labels)
    if cap is not None:
        order = Window.partitionBy("label").orderBy(F.url_decode(_path_part(F.col("audio_path"), 1)))
        rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")
    return rows


Transcriber = Callable[[str], tuple[Sequence[str], float]]


def transcribe(files: DataFrame, load: Callable[[], Transcriber]) -> DataFrame:
    """(id, label, transcript, audio_path, duration) by an injected recogniser, loaded once in a worker.

    It gives a file's segment texts and duration. Blank segments go, the rest is joined by a space; a file
    that fails has an empty transcript and duration 0. Without any file this is an error.
    """
    if files.isEmpty():
        raise ValueError("no audio files")
    return transcribe_files(files, load)


def transcribe_files(files: DataFrame, load: Callable[[], Transcriber]) -> DataFrame:
    """``transcribe`` without the look at whether there are files: also of a stream."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = load()
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    segments, duration = recogniser(r.audio_path)
                    text = " ".join(s for s in (x.strip() for x in segments) if s)
                except Exception:  # one unreadable file must not end the job
                    text, duration = "", 0.0
                rows.append((r.id, r.label, text, r.audio_path, float(duration)))
            yield pd.DataFrame(rows, columns=["id", "label", "transcript", "audio_path", "duration"])

    return files.mapInPandas(run, "id string, label string, transcript string, audio_path string, duration double")


def line_ordinal() -> Column:
    """Text that sorts like (file, split of the file, line in the split), of a row as it comes from a scan of files.

    An increasing id grows from line to line within a split, which one task reads; between splits their place in the
    file decides. So it doesn't matter how splits are put into partitions.
    """
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws("|", F.col("_metadata.file_path"), number(F.col("_metadata.file_block_start")), number(F.monotonically_increasing_id()))


def csv_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, *, infer: bool = False, separator: str = ",", ordered: bool = False, blanks: bool = False
) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line breaks and quotes. Without a schema all is text.

    ``ordered`` adds ``_line_at``, by which rows sort as they stand in the files. An empty field is null; with ``blanks``
    only one without quotes is, and a quoted one is an empty text.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", separator)
    # by default a NUL before a quote would be taken for an escape of it
    reader = reader.option("charToEscapeQuoteEscaping", '"')
    # Spark compares every field with what stands for null, which else is the empty text: a word that no file holds
    reader = reader.option("nullValue", f"null-{uuid.uuid4().hex}") if blanks else reader
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)
    return rows.withColumn("_line_at", line_ordinal()) if ordered else rows


def tsv_folder(spark: SparkSession, root: str) -> DataFrame:
    """(uid, seq, columns by name as a map) of the lines of every ``uid.tsv``; ``seq`` is the line's number.

    One distributed read of the folder; files are small, one subject each.
    """
    files = spark.read.option("pathGlobFilter", "*.tsv").text(root, wholetext=True)
    uid = F.regexp_replace(F.url_decode(_path_part(F.col("_metadata.file_path"), 1)), r"\.tsv$", "")
    lines = files.select(uid.alias("uid"), F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n").alias("lines"))
    rows = lines.select("uid", F.split(F.element_at("lines", 1), "\t").alias("head"), F.posexplode("lines").alias("seq", "line"))
    rows = rows.filter((F.col("seq") > 0) & (F.col("line") != ""))
    fields = F.split("line", "\t")
    return rows.select("uid", "seq", F.map_from_arrays("head", F.transform("head", lambda h, i: F.get(fields, i))).alias("fields"))


def tsv_segments(spark: SparkSession, root: str, columns: Sequence[str] = ("no", "start_time", "speaker", "value")) -> DataFrame:
    """Segments with text columns; a column that no file has is left out, so that its absence can be told."""
    rows = tsv_folder(spark, root)
    names = {r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().collect()}
    return rows.select("uid", "seq", *[F.col("fields")[c].alias(c) for c in columns if c in names])


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None, *, ordered: bool = False) -> DataFrame:
    """A JSON-lines corpus; without a schema, every primitive is text so that an id such as 0001 keeps its zeros.

    ``ordered`` adds ``_line_at``, by which records sort as they stand in the files.
    """
    rows = spark.read.schema(schema).json(path) if schema else spark.read.option("primitivesAsString", True).json(path)
    return rows.withColumn("_line_at", line_ordinal()) if ordered else rows


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, number, value) of all lines of text files; ``number`` counts from 1 in each file.

    A first scan counts the lines of each split; a line's number is its place in its split plus the lines before that.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("path").alias("p"), F.col("start").alias("s"), "first", before.alias("before"))
    # so many tasks read some ten thousand splits at most, a few megabytes
    splits = F.broadcast(splits) if lines.rdd.getNumPartitions() <= FEW_TASKS else splits
    found = lines.join(splits, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s")))
    return found.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"), "value")


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file with ``_line_at``, the line's number in its file from 0; blank lines are left out."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r"), (F.col("number") - 1).alias("_line_at")).select("r.*", "_line_at")


def checked_json_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, number, record) of every line that isn't blank, as JSON text; what isn't an object is wrapped as ``_value``.

    A line that isn't JSON fails the job with its file, number and text.
    """
    rows = numbered_lines(spark, paths).select("path", "number", F.trim("value").alias("line")).filter("line <> ''")
    valid = F.expr("try_parse_json(line)").isNotNull()
    failure = F.raise_error(F.concat(F.lit("not JSON in "), F.col("path"), F.lit(", line "), F.col("number"), F.lit(": "), F.col("line"))).cast("string")
    wrapped = F.concat(F.lit('{"_value": '), F.col("line"), F.lit("}"))
    return rows.select("path", "number", F.when(~valid, failure).when(F.col("line").startswith("{"), F.col("line")).otherwise(wrapped).alias("record"))


def word_vectors(spark: SparkSession, path: str, dim: int, most: int | None = None) -> DataFrame:
    """(word, vec) of a text file: lines with too few or unreadable numbers (a header, too) go, extra ones are cut.

    ``most`` counts good lines in the file's order; of a repeated word the last counts.
    """
    lines = spark.read.text(path).withColumn("at", line_ordinal())
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("float"))
    rows = lines.select("at", F.element_at(parts, 1).alias("word"), numbers.alias("vec"))
    rows = rows.filter((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull()))
    if most is not None:
        rows = rows.orderBy("at").limit(most)
    return rows.groupBy("word").agg(F.max_by("vec", "at").alias("vec"))


def folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, row_id, is_test) of a list of index pairs, or of the table that the document names; anything else is an error.

    The document is read by an executor, the table by as many as it has parts.
    """
    reader = spark.read.option("multiLine", True).schema("train_idx array<bigint>, test_idx array<bigint>, n_splits int, table string, _corrupt_record string")
    table = reader.json(path).withColumn("fold", F.monotonically_increasing_id().cast("int"))  # one file is read by one task
    complete = F.col("train_idx").isNotNull() & F.col("test_idx").isNotNull() & F.col("_corrupt_record").isNull()
    kinds = table.select("fold", complete, "n_splits", "table").collect()
    if len(kinds) == 1 and kinds[0]["table"] and kinds[0]["n_splits"]:
        rows = spark.read.parquet(f"{path.rpartition('/')[0] or '.'}/{kinds[0]['table']}")
        splits = F.explode(F.sequence(F.lit(0), F.lit(kinds[0]["n_splits"] - 1))).alias("k")
        return rows.select("row_id", F.col("fold").alias("own"), splits).select(F.col("k").alias("fold"), "row_id", (F.col("own") == F.col("k")).alias("is_test"))
    if not kinds or not all(k[1] for k in kinds):
        raise ValueError(f"{path}: not a list of train_idx and test_idx")
    one = lambda c, t: table.select("fold", F.explode(c).alias("row_id"), F.lit(t).alias("is_test"))
    return one("train_idx", False).unionByName(one("test_idx", True))


def metrics_document(path: str) -> dict:
    return json.loads(read_text(path))


def metrics_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run, method, fold, metric, value) of all numbers in the fold metrics of many documents; ``run`` is a document's path.

    Documents may say more or less: methods without folds and what isn't a number are left out, and a metric needs no
    place in a schema. A document that isn't JSON is an error. Each is read as a whole by one task.
    """
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.parse_json("value").alias("document"))
    inside = lambda c, path: spark.tvf.variant_explode(F.try_variant_get(F.col(c).outer(), path, "variant"))
    methods = rows.lateralJoin(inside("document", "$.methods")).select("run", F.col("key").alias("method"), F.col("value").alias("own"))
    folds = methods.lateralJoin(inside("own", "$.fold_metrics")).select("run", "method", F.try_variant_get("value", "$.fold", "int").alias("fold"), F.col("value").alias("own"))
    found = folds.lateralJoin(inside("own", "$")).select("run", "method", "fold", F.col("key").alias("metric"), F.try_variant_get("value", "$", "double").alias("value"))
    return found.filter((F.col("metric") != "fold") & F.col("value").isNotNull())


def texts_and_labels(df: DataFrame, label_col: str = "Diagnosis", text_columns: Sequence[str] = TEXT_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """(text, label, y, and the columns to ``keep``): the first text column there is, blank texts and null labels left out, labels numbered by name."""
    column = next((c for c in text_columns if c in df.columns), None)
    if column is None or label_col not in df.columns:
        raise ValueError(f"needs {label_col} and one of {list(text_columns)}")
    rows = df.select(present(F.col(column)).alias("text"), F.col(label_col).cast("string").alias("label"), *keep)
    rows = rows.filter((strip(F.col("text")) != "") & F.col("label").isNotNull())
    # a row for each label alone passes through the unpartitioned window
    names = rows.select(F.col("label").alias("_label")).distinct()
    names = names.withColumn("y", (F.row_number().over(Window.orderBy("_label")) - 1).cast("int"))
    return rows.join(names, F.col("label") == F.col("_label")).select("text", "label", "y", *keep)
