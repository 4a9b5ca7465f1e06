"""Batches of texts, kept small, and packed numbers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch at most; texts of a few kilobytes make a batch of about a megabyte.
ROWS, BYTES = 512, 4 << 20
#: Settings that bound what a task holds of texts at once: rows and bytes that go to Python, and rows read at once.
BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": BYTES,
    "spark.sql.parquet.columnarReaderBatchSize": ROWS,
}


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after its session's batches are bounded by ROWS rows and BYTES bytes.

    Whole batches are in memory several times over, in the executor and in its
    Python workers, so the defaults, thousands of rows, are too many for texts. The
    settings stay lowered: plans read them when they run, which is after the call.
    """
    conf = df.sparkSession.conf
    for key, most in BOUNDS.items():
        held = conf.get(key).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:  # sizes with a unit, and no bound at all, too
            conf.set(key, str(most))
    return df


def given_back(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """`function` over a task's batches, after whose end the worker's free memory goes back to the system.

    Workers serve one task after another, and what one has freed stays theirs: the
    peaks of all stages would add up beside the executor's heap.
    """

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def packed(values, width: int = 4) -> bytes:
    """Whole numbers from 0, of `width` bytes, to few bytes: their low bytes, then the next, and so on, compressed."""
    values = np.ascontiguousarray(values, f"<u{width}")
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    """The numbers that were packed: bytes of one, else long."""
    size = int.from_bytes(data[:8], "little") * width
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    return planes[0] if width == 1 else np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0].astype(np.int64)
