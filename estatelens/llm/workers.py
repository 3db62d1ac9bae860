"""Small helpers of the operators, most for code that runs in Python workers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once; Spark's own limit of bytes applies too.
BATCH_ROWS = 2000

_STORE = "_estatelens_worker_store"


def kept(key, make: Callable):
    """The object of this worker process under ``key``, made on first use.

    Workers are used again for later tasks, so a tokenizer is loaded once per process, not per task.
    Only things that can be made again from ``key`` go here; a lost worker loses nothing but time.
    """
    store = sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep batches for Python workers small, so that two of them fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def free(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def strings(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(
    batches: Iterator[pa.RecordBatch], column: int, size: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of a text column, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)
        pa.default_memory_pool().release_unused()
