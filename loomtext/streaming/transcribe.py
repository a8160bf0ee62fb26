"""Transcription that saves as it goes: the audio tree as a stream of files, in small batches, into an append sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from loomtext.sources.files import file_exists
from loomtext.sources.readers import FILE_SCHEMA, Transcriber, audio_files, audio_tree, csv_table, transcribe_files
from loomtext.sources.writers import TRANSCRIPT_COLUMNS, transcript_rows

#: Where a table keeps what it has taken in: a folder in it that readers pass over, gone when the table is.
PROGRESS = "_progress"


def new_audio(spark: SparkSession, root: str, labels: Sequence[str] | None = None, cap: int | None = None, *, batch: int) -> DataFrame:
    """``audio_tree`` as a stream, ``batch`` files at a time. A cap holds for the files that are there at the start."""
    stream = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*")
        .option("maxFilesPerTrigger", batch).option("latestFirst", "false").load(root)
    )
    files = audio_files(stream, labels)
    if cap is None:
        return files
    first = audio_tree(spark, root, labels, cap).select("audio_path")
    return files.join(first, "audio_path", "left_semi").select("label", "id", "audio_path")


def transcribe_new(
    spark: SparkSession, root: str, target: str, load: Callable[[], Transcriber], *, labels: Sequence[str] | None = None, cap: int | None = None, batch: int | None = None
) -> DataFrame:
    """Recognises the files that the CSV table at ``target`` doesn't hold yet, adds them, and returns the whole table.

    Each batch is one commit: it is in the table as a whole or not at all, and a run that ends half-way leaves the batches
    before. The next run goes on with the batch that was broken off: at most its files (``batch``, by default one for
    each core) are recognised again, and no file is in the table twice. Deleting the table begins anew. A tree
    without audio files is an error.
    """
    batch = batch or spark.sparkContext.defaultParallelism
    found = transcript_rows(transcribe_files(new_audio(spark, root, labels, cap, batch=batch), load))
    writer: DataStreamWriter = found.writeStream.format("csv").outputMode("append").trigger(availableNow=True)
    writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.option("checkpointLocation", f"{target}/{PROGRESS}").start(target).awaitTermination()
    if not file_exists(f"{target}/_spark_metadata") or (table := csv_table(spark, target, ", ".join(f"{c} string" for c in TRANSCRIPT_COLUMNS))).isEmpty():
        raise ValueError("no audio files")
    return table
