"""Arrays stored as tables of encoded chunks: (chunk coordinates, payload), and their cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Malformed
from tessera.functions import codecs
from tessera.operators.selection import Slab


@dataclass(frozen=True)
class Layout:
    """How an array is chunked. kind: a numpy type with byte order; axes: names of the index columns."""

    axes: tuple[str, ...]
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    kind: str = "<f4"
    filters: tuple[int, ...] = ()
    fill: float = 0
    coordinates: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "coordinates", tuple(f"chunk_{a}" for a in self.axes))

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))

    @property
    def value_type(self) -> T.DataType:
        kinds = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType()}
        return kinds[self.kind[1:]]


def encoded(cells: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Chunks of (axes, value): grouped by chunk, edge chunks full-size with the fill value past the edge."""
    place = reduce(lambda at, ac: at * F.lit(ac[1]) + F.col(ac[0]) % ac[1], zip(layout.axes, layout.chunk, strict=True), F.lit(0))
    keys = [F.floor(F.col(a) / c).cast("long").alias(k) for a, c, k in zip(layout.axes, layout.chunk, layout.coordinates, strict=True)]
    grouped = cells.select(*keys, place.cast("int").alias("place"), F.col(value).cast(layout.value_type).alias("value"))
    grouped = grouped.groupBy(*layout.coordinates).agg(F.collect_list("place").alias("places"), F.collect_list("value").alias("values"))
    schema = grouped.select(*layout.coordinates).schema.add("payload", "binary")
    kind, n, filters = np.dtype(layout.kind), prod(layout.chunk), list(layout.filters)

    def run(batches):
        for batch in batches:
            out = []
            for places, values in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                cells_ = np.full(n, layout.fill, dtype=kind)
                cells_[places] = values
                out.append(codecs.encode(cells_.tobytes(), filters, kind.itemsize))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary())], schema.names)

    return grouped.mapInArrow(run, schema)


def decoded(chunks: DataFrame, layout: Layout) -> DataFrame:
    """The chunks with `values` in place of the payload; a short payload is malformed."""
    kind, n, filters = np.dtype(layout.kind), prod(layout.chunk), list(layout.filters)
    kept = list(layout.coordinates)
    schema = chunks.select(*kept).schema.add("values", T.ArrayType(layout.value_type))
    arrow = pa.from_numpy_dtype(kind.newbyteorder("="))

    def run(batches):
        for batch in batches:
            flat = []
            for payload in batch.column(batch.num_columns - 1).to_pylist():
                raw = codecs.decode(payload, filters, kind.itemsize, n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise Malformed(f"a chunk of {len(raw)} bytes, not {n * kind.itemsize}")
                flat.append(np.frombuffer(raw, kind, n).astype(kind.newbyteorder("=")))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, kind.newbyteorder("=")), arrow)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * n), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], schema.names)

    return chunks.select(*kept, "payload").mapInArrow(run, schema)


def cells(chunks: DataFrame, layout: Layout, slab: Slab | None = None) -> DataFrame:
    """(axes, value) of the stored cells in the selection: chunks outside are dropped before they are decoded."""
    slab = slab or Slab.of(layout.shape)
    wanted = decoded(chunks.where(slab.chunk_filter(layout.coordinates, layout.chunk)), layout)
    each = wanted.select(*layout.coordinates, F.posexplode("values").alias("place", "value"))
    out, rest = [], F.col("place")
    for a, c, k in reversed(list(zip(layout.axes, layout.chunk, layout.coordinates, strict=True))):
        out.insert(0, (F.col(k) * c + rest % c).cast("long").alias(a))
        rest = F.floor(rest / c)
    return each.select(*out, "value").where(slab.filter(layout.axes))


def grid(spark, layout: Layout, slab: Slab | None = None) -> DataFrame:
    """Every chunk coordinate of the array that meets the selection."""
    slab = slab or Slab.of(layout.shape)
    n = prod(layout.grid)
    out, rest = [], F.col("id")
    for k, size in reversed(list(zip(layout.coordinates, layout.grid, strict=True))):
        out.insert(0, (rest % size).cast("long").alias(k))
        rest = F.floor(rest / size)
    return spark.range(n).select(*out).where(slab.chunk_filter(layout.coordinates, layout.chunk))


def missing(chunks: DataFrame, layout: Layout, slab: Slab | None = None) -> DataFrame:
    """Chunks of the selection that were never written."""
    return grid(chunks.sparkSession, layout, slab).join(chunks.select(*layout.coordinates).distinct(), list(layout.coordinates), "left_anti")


def filled(chunks: DataFrame, layout: Layout, slab: Slab | None = None) -> DataFrame:
    """cells(), and the fill value for the cells of missing chunks."""
    slab = slab or Slab.of(layout.shape)
    n = prod(layout.chunk)
    absent = missing(chunks, layout, slab).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    out, rest = [], F.col("place")
    for a, c, k in reversed(list(zip(layout.axes, layout.chunk, layout.coordinates, strict=True))):
        out.insert(0, (F.col(k) * c + rest % c).cast("long").alias(a))
        rest = F.floor(rest / c)
    blank = absent.select(*out, F.lit(layout.fill).cast(layout.value_type).alias("value")).where(slab.filter(layout.axes))
    return cells(chunks, layout, slab).unionByName(blank)


def described(layout: Layout, chunks: DataFrame) -> DataFrame:
    """Each stored chunk with its first cell, its clipped extent and stored size."""
    columns = []
    for a, n, c, k in zip(layout.axes, layout.shape, layout.chunk, layout.coordinates, strict=True):
        columns += [(F.col(k) * c).alias(f"first_{a}"), F.least(F.lit(c), F.lit(n) - F.col(k) * c).cast("long").alias(f"count_{a}")]
    return chunks.select(*layout.coordinates, *columns, F.octet_length("payload").alias("stored"))
