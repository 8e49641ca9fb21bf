"""Row-wise operators over whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bytescan import CHUNK_BYTES, Chunk, chunks


def map_text(df: DataFrame, text_col: str, schema: str, fn: Callable[[Chunk], dict[str, Any]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Append the columns of schema, which fn makes for each chunk of rows.

    A null text counts as empty.  An input column with the name of a result is
    replaced by the result; all others pass unchanged.
    """
    new = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name not in set(new.names)]
    out = T.StructType(kept + list(new.fields))
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(text_col), limit):
                made = fn(chunk)
                part = batch.slice(int(chunk.rows[0]), chunk.n)
                cols = [part.column(n) for n in names]
                cols += [v.cast(k) if isinstance(v := made[n], pa.Array) else pa.array(v, type=k) for n, k in zip(new.names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names + new.names)

    return df.mapInArrow(run, out)


def emit_text(df: DataFrame, text_col: str, schema: str, fn: Callable[[Chunk, pa.RecordBatch], Iterator[dict[str, Any]]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Any number of rows from each chunk; fn gets the chunk and its slice of the batch."""
    out = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(text_col), limit):
                for made in fn(chunk, batch.slice(int(chunk.rows[0]), chunk.n)):
                    yield pa.RecordBatch.from_arrays([v.cast(k) if isinstance(v := made[n], pa.Array) else pa.array(v, type=k) for n, k in zip(out.names, kinds, strict=True)], names=out.names)

    return df.mapInArrow(run, out)
