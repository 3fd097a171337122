"""Row-wise numpy work on Arrow batches that leaves the other columns alone."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Work = Callable[..., Sequence[pa.Array]]


def trim() -> None:
    """Give freed memory back to the system.

    Spark keeps a Python worker for later tasks, where what the allocators hold would count
    beside those tasks' own needs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def free(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it while a given column is called so, in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def annotate(
    df: DataFrame, inputs: Sequence[str], added: str, start: Callable[[], Work], keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) plus the columns ``added`` that ``start()(*inputs)`` computes.

    ``start`` runs once per task, so it may open files or hold a cache; the function it
    returns gets one Arrow array per input and returns one array per added column.
    An input column may be called like an added one; a kept one may not.
    """
    keep = list(df.columns if keep is None else keep)
    extra = StructType.fromDDL(added)
    clash = set(keep) & set(extra.names)
    if clash:
        raise ValueError(f"columns that are kept and added: {sorted(clash)}")
    schema = StructType([*(df.schema[c] for c in keep), *extra])
    n, names = len(inputs), schema.names
    source = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)], *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[n:], *work(*columns[:n])], names=names)
            del batch, columns
        del work
        trim()

    return source.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text is an empty one."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], offsets - first


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
