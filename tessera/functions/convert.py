"""Numeric conversion as Column expressions: integers wrap, floats truncate and saturate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import Unsupported

#: Name to (bits, signed, Spark type that holds every value).
INTEGERS = {"i8": (8, True, "tinyint"), "i16": (16, True, "smallint"), "i32": (32, True, "int"), "i64": (64, True, "bigint"), "u8": (8, False, "smallint"), "u16": (16, False, "int"), "u32": (32, False, "bigint"), "u64": (64, False, "decimal(20,0)")}
FLOATS = {"f32": "float", "f64": "double"}


def wrapped(value: Column, to: str) -> Column:
    """An integer column reduced modulo two to the width of the target, as its signed or unsigned reading."""
    bits, signed, kind = INTEGERS[to]
    if bits == 64:
        wide = value.cast("decimal(38,0)")
        modulus, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
        rest = F.pmod(wide, modulus)
        return (F.when(rest >= half, rest - modulus).otherwise(rest) if signed else rest).cast(kind)
    modulus, half = F.lit(1 << bits), F.lit(1 << bits - 1)
    rest = F.pmod(value, modulus)
    # adding half before the second remainder cannot overflow, as rest is already small
    return (F.pmod(rest + half, modulus) - half if signed else rest).cast(kind)


def saturated(value: Column, to: str) -> Column:
    """A float column truncated towards zero and held within the target's limits; NaN becomes 0."""
    bits, signed, kind = INTEGERS[to]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    value = value.cast("double")
    inside = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if bits < 64 else value
    if kind == "decimal(20,0)":  # a decimal made from a double has 17 digits, two halves have them all
        upper = F.floor(value / float(1 << 32))
        inside = upper.cast(kind) * F.lit(1 << 32).cast(kind) + F.floor(value - upper * float(1 << 32)).cast(kind)
    limit = lambda n: F.lit(str(n)).cast(kind)
    return F.when(F.isnan(value), limit(0)).when(value >= float(high), limit(high)).when(value <= float(low), limit(low)).otherwise(inside.cast(kind))


def converted(value: Column, source: str, to: str) -> Column:
    """`value` of numeric type `source` as type `to`."""
    if source not in INTEGERS | FLOATS or to not in INTEGERS | FLOATS:
        raise Unsupported(f"no numeric conversion from {source} to {to}")
    if source == to:
        return value
    if to in FLOATS:
        return value.cast(FLOATS[to])
    return wrapped(value, to) if source in INTEGERS else saturated(value, to)


def sign_extended(value: Column, bits: int) -> Column:
    """The low `bits` of an integer read as a signed number."""
    return F.shiftright(F.shiftleft(value.cast("bigint"), 64 - bits), 64 - bits)
