"""What several of the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: One word of the contracts, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; pure ASCII takes the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves no remainder by 5; rows without id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, named ``t1`` and ``t2``."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # other C libraries than glibc
    _trim = None


def give_back() -> None:
    """Return to the system what Arrow and the C library keep for later; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary or string) holds about ``most_bytes``; no row is split.

    What is kept for later is given back after each batch.
    """
    for batch in batches:
        values = batch.column(column)
        size = values.nbytes or 1
        rows = max(1, int(batch.num_rows * most_bytes / size))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del values
        give_back()


def output_schema(df: DataFrame, columns: Iterable[str], extra: str) -> str:
    """A DDL schema: some columns of ``df`` as they are, then ``extra``."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in set(columns)]
    return ", ".join([*kept, extra])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores in front until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
