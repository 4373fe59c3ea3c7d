"""What the corpus operators share: written tables of the shared folder, and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwyne.sources.shared import discard, materialise, new_path, shared_dir

#: The ASCII white space that the word and line rules of this package use.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each Arrow batch than Spark's default: texts are long, and each batch is held several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key as a long and the text; other columns, whatever their names, stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


__all__ = ["ASCII_SPACE", "bounded_batches", "discard", "keyed_text", "materialise", "new_path", "raw_texts", "shared_dir", "slices"]
