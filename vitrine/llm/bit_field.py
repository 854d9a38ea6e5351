"""A bit field of fixed size that tells which keys occur: no key is missed, a few others pass."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.columns import sliced

#: Tasks that put the fields of other tasks together before the driver gets theirs.
MERGERS = 8


def place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bit_field(places: DataFrame, bits: int) -> np.ndarray:
    """``places(k)``, 0 to 2**bits - 1 -> one boolean per place."""
    size = 1 << bits

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(size, bool)
        for batch in batches:
            field[batch.column("k").to_numpy(zero_copy_only=False)] = True
        if field.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(field).tobytes()], pa.binary())], names=["field"])

    def either(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // 8, np.uint8)
        for batch in sliced(batches, 4):
            for x in batch.column("field").to_pylist():
                total |= np.frombuffer(x, np.uint8)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["field"])

    schema = "field binary"
    out = np.zeros(size // 8, np.uint8)
    for r in places.select("k").mapInArrow(mark, schema).repartition(MERGERS).mapInArrow(either, schema).collect():
        out |= np.frombuffer(r["field"], np.uint8)
    return np.unpackbits(out).astype(bool)
