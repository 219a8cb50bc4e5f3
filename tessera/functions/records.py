"""Compound records: fixed-size binary values with members at byte offsets, as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.errors import Malformed

KINDS = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
ARROW = {"i1": pa.int8(), "i2": pa.int16(), "i4": pa.int32(), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}


def structure(members: list[tuple[str, str, int]], size: int) -> np.dtype:
    """The numpy type of (name, numpy kind, offset) members in records of a size."""
    return np.dtype({"names": [m[0] for m in members], "formats": [m[1] for m in members], "offsets": [m[2] for m in members], "itemsize": size})


def packed(rows: DataFrame, members: list[tuple[str, str, int]], size: int, into: str = "record") -> DataFrame:
    """rows with its member columns packed into one binary column."""
    names, kind = [m[0] for m in members], structure(members, size)
    rest = [c for c in rows.columns if c not in names]
    schema = rows.select(*rest).schema.add(into, "binary")

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, kind)
            for name, form, _ in members:
                column = batch.column(batch.schema.get_field_index(name))
                out[name] = [x.encode() for x in column.to_pylist()] if form[0] == "S" else column.to_numpy(zero_copy_only=False)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array([raw[i * size : (i + 1) * size] for i in range(len(out))], pa.binary())], schema.names)

    return rows.select(*rest, *names).mapInArrow(run, schema)


def unpacked(rows: DataFrame, members: list[tuple[str, str, int]], size: int, record: str = "record") -> DataFrame:
    """rows with the members of its binary column; strings end at the first NUL. A record of another size is malformed."""
    kind = structure(members, size)
    rest = [c for c in rows.columns if c != record]
    schema = rows.select(*rest).schema
    for name, form, _ in members:
        schema = schema.add(name, T.StringType() if "S" in form else KINDS[form[-2:]])

    def run(batches):
        for batch in batches:
            payload = batch.column(batch.num_columns - 1).to_pylist()
            if any(len(p) != size for p in payload):
                raise Malformed(f"a record that has not {size} bytes")
            values = np.frombuffer(b"".join(payload), kind)
            out = []
            for name, form, _ in members:
                column = values[name]
                out.append(pa.array([x.split(b"\0")[0].decode("utf-8", "replace") for x in column.tolist()], pa.string()) if "S" in form else pa.array(column.astype(column.dtype.newbyteorder("=")), ARROW[form[-2:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], schema.names)

    return rows.select(*rest, record).mapInArrow(run, schema)
