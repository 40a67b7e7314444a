"""Shared plumbing: Arrow batches bounded by bytes, hashing; staged tables are those of the store."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.store import discard, shared_dir, stage_table

__all__ = ["column", "discard", "documents", "map_texts", "shared_dir", "slices", "stage_table", "unit_hash"]

#: Text bytes handed to a kernel at once; a single longer text is a batch by itself.
BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str | None, budget: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``budget`` bytes of text (one row at least); whole without a text column."""
    if text is None:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > budget and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def trim() -> None:
    """Give back to the system what a task has freed; the worker lives on, and shares its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def map_texts(
    df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], dict[str, Any] | None]], schema: str | StructType, text: str | None = "text"
) -> DataFrame:
    """Run ``kernel()`` once a task; what it returns maps slices of the batches to columns of ``schema``. Its ``close``, if any, ends the task."""
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        step = kernel()
        try:
            for batch in batches:
                for part in slices(batch, text):
                    cols = step(part)
                    if cols is not None:
                        yield pa.RecordBatch.from_arrays(
                            [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow
                        )
        finally:
            getattr(step, "close", lambda: None)()
            trim()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def unit_hash(*cols: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the columns' text; SQL engines agree on it."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
