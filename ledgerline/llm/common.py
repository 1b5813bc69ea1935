"""Reading tables and writing intermediate ones."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.scratch import dropped, shared_dir, written

__all__ = ["dropped", "row_keys", "shared_dir", "table", "trimmed", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that know a row by its id and text (null counts as empty), as columns key and key2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.col(id_col), text).alias("key"), F.xxhash64(F.lit("2"), F.col(id_col), text).alias("key2")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """``run``, at the end of which the worker gives its free memory back, as it lives on beside other work."""

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return trimming


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
