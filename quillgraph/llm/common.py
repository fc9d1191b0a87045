"""What the training-data operators share: reading, shared-folder tables, Arrow text buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(names: list[str]) -> list[F.Column]:
    """Columns under names that clash with none of an operator's own."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(f"own_{i}") for i, c in enumerate(names)]


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but for those with these names, in whatever case."""
    return [c for c in df.columns if c.lower() not in names]


def restored(names: list[str]) -> list[F.Column]:
    """The columns that renamed() put away, under their names."""
    return [F.col(f"own_{i}").alias(c) for i, c in enumerate(names)]


def words(text: str | F.Column) -> F.Column:
    """Number of words, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the bounds of its rows (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; every text stays whole."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def give_back() -> None:
    """Return freed memory to the system, as idle Python workers share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
