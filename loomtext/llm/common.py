"""What the operators of this subpackage share: tables, words and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles in one go; keeps memory bounded whatever the batch size.
CHUNK_BYTES = 4 << 20

#: For ``bytes.translate``: A-Z to a-z; every ASCII character but 0-9 and a-z becomes a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, unchanged; a null text has none."""
    return text.encode().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null: none."""
    return text.encode().translate(ALNUM_TABLE).split() if text else []


def chunks(batches: Iterable[pa.RecordBatch], text_at: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in column ``text_at``, one row at least."""
    for batch in batches:
        column, start, size = batch.column(text_at), 0, 0
        if column.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for at, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    df: DataFrame, schema: str, prepare: Callable[[], Callable[[list, list], list]], id_col: str, text_col: str
) -> DataFrame:
    """Only id and text go to the workers; ``prepare()`` runs once a task and gives (ids, texts) -> columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for part in chunks(batches, 1):
            columns = work(part.column(0).to_pylist(), part.column(1).to_pylist())
            arrays = [
                c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def id_type(df: DataFrame, id_col: str) -> str:
    return dict(df.dtypes)[id_col]
