"""What the operators share: word rule, tables, and results kept in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept

__all__ = ["SPACE", "bucket_of", "frugal", "kept", "table"]

Batches = Iterator[pa.RecordBatch]

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, a function of mapInArrow, in a worker that gives memory back after
    each batch, so that what one batch or task needed is not held by the next."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())  # the others keep what is freed
        for batch in run(batches):
            yield batch
            del batch
            _trim()(0)
        _trim()(0)

    return wrapped
