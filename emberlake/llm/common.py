"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; everything else belongs to a word.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())
LOWER_CHARS = str.maketrans(_UPPER, _UPPER.lower())
STRIP = " \t\n\x0b\x0c\r"
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, natively."""
    return F.array_remove(F.split(text, SPACES), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: str) -> list[str]:
    """The words of a text in a task. str.split() alone would also cut at other Unicode spaces."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return _BYTE_SPLIT(text)


def _BYTE_SPLIT(text: str) -> list[str]:
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; an input column of the same name (in any case) gives way."""
    names = {n.lower() for n in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: one row, or several with at most ``most`` bytes of the named text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(name)).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n
