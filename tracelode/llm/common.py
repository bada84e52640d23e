"""What the operators share: durable intermediate tables, column hygiene and bounded Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_stored, free_shuffles, new_path, shared_dir, ship, spread, stored  # noqa: F401  operators take them from here

#: Text bytes that one vectorised step holds; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20
#: Stands for a null identifier: it sorts after every other one.
NO_ID = (1 << 63) - 1
#: Tables that a Python worker keeps from task to task for the steps that use them; each module adds its own.
KEPT: list[dict] = []


def forget() -> None:
    """Empties the tables that other steps have left in this Python worker."""
    for table in KEPT:
        table.clear()


def give_back() -> None:
    """Returns this Python worker's free memory to the system: the allocators of Arrow and C would hold it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(step: Callable, keep: bool = False) -> Callable:
    """A step for mapInArrow that begins without what other steps have left in its worker (unless it is to keep that) and gives back what it took.

    Workers live through many stages, and all of an executor's take turns: what each of them holds after a task adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., which no helper column is named, and the names c.. by the old ones."""
    back = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*back.values()), back


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def order_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits a batch so that a slice holds at most so many bytes of a string column, or one row."""
    text = batch.column(column)
    ends = string_offsets(text)
    start = 0
    while start < len(text):
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(text))
        yield batch.slice(start, stop - start)
        start = stop


def string_offsets(text: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string array, as they stand in its data buffer."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    if text.buffers()[1] is None or len(text) == 0:
        return np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def string_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values in them, from 0."""
    ends = string_offsets(text)
    data = text.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)
