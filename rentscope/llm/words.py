"""Words, batches and shared-folder writes that the text operators have in common.

A word is a run of characters other than the six ASCII white-space characters. Null text counts as empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.session import ensure_checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text, empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text; ``bytes.split`` knows exactly the six ASCII blanks."""
    return text.split() if text else []


def words_in_a_row(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in a row, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    found = parts.flatten()
    filled = pc.greater(pc.binary_length(found), 0)  # blanks at an end of a text leave empty parts
    kept = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
    return found.filter(filled).cast(pa.binary()), np.diff(kept[parts.offsets.to_numpy()])


def lowered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All A-Z-lowered words of a text column in a row, and how many each text has."""
    return words_in_a_row(pc.ascii_lower(texts.cast(pa.string())))


def texts_of(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = 4 << 20) -> Iterator[tuple[list, ...]]:
    """Column values of Arrow batches, cut into runs of rows with at most ``limit`` bytes of text (one row at least).

    The first column is the text, given as UTF-8 bytes or None.
    """
    yield from map(_values, runs_of(batches, *columns, limit=limit))


def text_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of each text, none for null."""
    return pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0)


def runs_of(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = 4 << 20, sized: bool = False) -> Iterator[pa.RecordBatch]:
    """The runs of rows of ``texts_of`` as Arrow batches; the first column may hold the bytes of texts that are not there (``sized``)."""
    for batch in batches:
        table = batch.select(list(columns))
        start, size = 0, 0
        lengths = (table.column(0) if sized else text_bytes(table.column(0))).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield table.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield table.slice(start)


def _values(batch: pa.RecordBatch) -> tuple[list, ...]:
    first = batch.column(0).cast(pa.binary()).to_pylist()
    return (first, *(batch.column(i).to_pylist() for i in range(1, batch.num_columns)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder as Parquet and read back: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what a finished task has freed back to the system: its Python worker stays, idle, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
