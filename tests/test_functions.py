import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import Malformed, Unsupported
from tessera.functions import codecs, convert, text

BYTES = st.binary(max_size=300)


@given(BYTES, st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_shuffles_round_trip(data, size):
    assert codecs.unshuffled(codecs.shuffled(data, size), size) == data
    assert codecs.unbitshuffled(codecs.bitshuffled(data, size), size) == data


@given(BYTES, st.lists(st.sampled_from([codecs.DEFLATE, codecs.SHUFFLE, codecs.FLETCHER32, codecs.ZSTD]), max_size=4))
@settings(max_examples=60, deadline=None)
def test_filters_round_trip(data, filters):
    stored = codecs.encode(data, filters, 4)
    assert codecs.decode(stored, filters, 4, len(data) + 64)[: len(data)] == data


def test_filter_refusals():
    with pytest.raises(Unsupported):
        codecs.decode(b"x", [4], 4, 1)
    with pytest.raises(Malformed):
        codecs.decode(b"not deflate", [codecs.DEFLATE], 4, 10)
    stored = bytearray(codecs.encode(b"abcdefgh", [codecs.FLETCHER32], 4))
    stored[0] ^= 1
    with pytest.raises(Malformed):
        codecs.decode(bytes(stored), [codecs.FLETCHER32], 4, 8)
    assert codecs.decode(b"as it is", [codecs.DEFLATE], 4, 8, mask=1) == b"as it is"


def slow_fletcher(data):
    data += b"\0" * (len(data) % 2)
    first = second = 0
    for (w,) in struct.iter_unpack(">H", data):
        first += w
        second += first
    fold = lambda x: x % 65535 or (65535 if x else 0)
    return fold(second) << 16 | fold(first)


@given(BYTES)
@settings(max_examples=60, deadline=None)
def test_fletcher32(data):
    assert codecs.fletcher32(data) == slow_fletcher(data)


def test_lookup3_known_values():
    # published with the algorithm
    assert codecs.lookup3([b""])[0] == 0xDEADBEEF
    assert codecs.lookup3([b"Four score and seven years ago"])[0] == 0x17770551
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in range(60)]
    assert codecs.lookup3(values).tolist() == [int(codecs.lookup3([v])[0]) for v in values]


EDGES = [0.0, -0.0, 0.5, -0.5, 1.9, -1.9, 127.0, 128.0, -129.0, 255.5, 256.0, 65535.9, 2.0**31, -(2.0**31) - 1, 2.0**63, -(2.0**63), 1e30, -1e30, float("inf"), float("-inf"), float("nan")]


@pytest.mark.parametrize("to", list(convert.INTEGERS))
def test_floats_saturate(spark, to):
    bits, signed, _ = convert.INTEGERS[to]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(EDGES)], "i int, x double").select("i", convert.converted(F.col("x"), "f64", to).alias("v")).collect()
    for r in rows:
        x = EDGES[r["i"]]
        assert int(r["v"]) == (0 if np.isnan(x) else high if x >= high else low if x <= low else int(x)), x


@pytest.mark.parametrize("to", list(convert.INTEGERS))
def test_integers_wrap(spark, to):
    values = [0, 1, -1, 127, 128, -128, -129, 255, 256, 2**31, -(2**31) - 1, 2**63 - 1, -(2**63)]
    bits, signed, _ = convert.INTEGERS[to]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x long").select("i", convert.wrapped(F.col("x"), to).alias("v")).collect()
    for r in rows:
        want = values[r["i"]] % (1 << bits)
        assert int(r["v"]) == (want - (1 << bits) if signed and want >> bits - 1 else want)


def test_text(spark):
    row = spark.createDataFrame([("ab \0x", "ab  ")], "a string, b string").select(text.fixed_string(F.col("a"), "null").alias("n"), text.fixed_string(F.col("a"), "space").alias("s"), text.fixed_string(F.col("b"), "space").alias("t")).first()
    assert tuple(row) == ("ab ", "ab", "ab")
    with pytest.raises(Unsupported):
        convert.converted(F.lit("x"), "text", "i8")
