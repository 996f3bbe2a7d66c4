"""Readers for the driver's tables and small helpers that several operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that an operator's Python side holds as one block (a longer text is a block of its own).
BLOCK_CHARS = 4_000_000


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 18)  # larger blocks always come straight from the system, and go back when freed
except (OSError, AttributeError):  # another C library: nothing to tune
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, mod parts; null ids are in no fold (null)."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")) % parts


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


_KEPT: dict[tuple, object] = {}


def kept(make: Callable[..., object], *args: object) -> object:
    """make(*args), once per worker process: Spark keeps Python workers, and with them what they have learnt."""
    key = (make, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]


def release_memory() -> None:
    """Gives freed memory back to the system; workers are kept and would hold on to it between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BLOCK_CHARS, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `chars` bytes of text and `rows` rows at most: memory depends on no batch's size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if (held and held + size > chars) or i - start == rows:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """rows.mapInArrow(run) with the same columns, whose names may be any (mapInArrow itself takes none with a dot).

    A task's end gives memory back, as workers go on to other stages.
    """
    names = rows.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.rename_columns(names) for batch in batches)
        release_memory()

    return rows.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, rows.schema)
