"""Shared helpers: tables, written tables, Arrow passes over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import fresh_path, ship

TEXT = "_text_of_row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 512,
           size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``rows`` rows and, but for one long text, ``size`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = max(start + 1, min(stop, start + rows, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name`` with underscores that no column has."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def map_texts(df: DataFrame, keep: Sequence[str], text: str, fields: Sequence[T.StructField],
              start: Callable[[], Callable[[list], list]], rows: int = 512, size: int = 4 << 20) -> DataFrame:
    """``keep`` columns plus new ``fields`` computed from whole texts, batch by batch.

    ``start()`` runs once a task and returns a function from a list of texts (None for
    null) to one Arrow array or list per field. New fields replace kept columns of the same name.
    """
    fields = list(fields)
    new = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [_arrow(f.dataType) for f in fields]
    texts = unused(TEXT, keep)
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        work = start()
        for part in slices(batches, texts, rows, size):
            out = work(part.column(texts).to_pylist())
            out = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], names=names)

    ship(df.sparkSession)
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(texts))
    return chosen.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
            T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(kind)]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind])


def lists(raw: bytes | np.ndarray | pa.Array, lengths: Sequence[int], kind=np.int32) -> pa.ListArray:
    """A list column from one flat buffer and the length of each list."""
    flat = np.frombuffer(raw, kind) if isinstance(raw, bytes) else raw
    flat = flat if isinstance(flat, pa.Array) else pa.array(flat)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
