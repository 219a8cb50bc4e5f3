"""Bloom filters of a fixed size, which keep rows from moving to a join that most of them have no partner in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter, and bits set in one word for each key: a broadcast of so many rows of two numbers at
#: most, whatever the input. With too many keys for it, a sieve lets all rows through.
WORDS, HASHES = 1 << 19, 4


def word() -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(WORDS))


def mask() -> Column:
    at = F.xxhash64(F.lit(2), "key")
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(at, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(HASHES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (with a `key`) and `possible`: false if the key is surely not among the keys."""
    words = keys.select(word().alias("word"), mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    both = rows.withColumn("word", word()).join(F.broadcast(words), "word", "left")
    return both.withColumn("possible", F.coalesce(F.col("bits").bitwiseAND(mask()) == mask(), F.lit(False))).drop("word", "bits")


def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the other column of `found` (key, column), null where there is none."""
    name, kind = next((f.name, f.dataType) for f in found.schema if f.name != "key")
    both = marked(rows, found.select("key"))
    moved = both.where("possible").drop("possible").join(found.hint("shuffle_hash"), "key", "left")
    return moved.unionByName(both.where("not possible").drop("possible").withColumn(name, F.lit(None).cast(kind)))
