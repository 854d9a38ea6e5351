"""Helpers around Arrow batch functions."""
from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose texts are Python strings at one time.
SLICE_ROWS = 256
#: Rows that go to a Python worker together. Spark's default of 10,000 is for narrow rows; with texts it holds hundreds of megabytes
#: in each task, once on either side.
BATCH_ROWS = 1_000
#: Bytes after which such a batch ends, however few rows it has: very long texts would end a worker otherwise.
BATCH_BYTES = 16 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to keep batches of whole texts small, in rows and in bytes. The session keeps these settings,
    since batches are cut when the result is read; they change no result."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more.values()], names=[*keep, *more])


def per_process(key: tuple, build: Callable[[], Any]) -> Any:
    """``build()`` once per Python worker. Functions of this package travel with each task by value, so a global of
    ours would be new for every task; tokenizer files are worth loading once."""
    held = sys.modules.setdefault("vitrine_worker_values", types.ModuleType("vitrine_worker_values")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def latest(kind: str, key: str, build: Callable[[], Any]) -> Any:
    """As ``per_process``, but only the value of the last key of a kind is kept: models of earlier jobs are let go."""
    held = per_process(("latest", kind), dict)
    if key not in held:
        held.clear()
        held[key] = build()
    return held[key]


def let_go() -> None:
    """Forget what earlier jobs left in this worker (tokenizers, models) and hand the memory back. For functions that need none of it; where it is
    wanted again it is loaded again."""
    held = vars(sys.modules.get("vitrine_worker_values", types.ModuleType("none")))
    for key in [k for k in held if isinstance(k, tuple)]:
        del held[key]
    hand_back()


def hand_back() -> None:
    """Hand back free memory, which a worker that waits for its next task would keep from the others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # other C libraries have no such call and give memory back by themselves
