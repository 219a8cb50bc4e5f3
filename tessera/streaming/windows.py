"""Array cells as streams: time decoded from its units, tumbling windows with a watermark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Unsupported

SECONDS = {"microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def decoded_time(value: Column, units: str) -> Column:
    """A timestamp without a zone from a number and units such as `days since 1970-01-01`."""
    found = re.fullmatch(r"(\w+) since (\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2})?)", units.strip())
    if not found or found[1] not in SECONDS:
        raise Unsupported(f"units {units!r}")
    micros = value if found[1] == "microseconds" else F.round(value * SECONDS[found[1]] * 1_000_000)
    seconds = (micros.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit(found[2]).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def tumbling(rows: DataFrame, time: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of `value` by window; of a stream, rows later than the watermark are left out."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sliding(rows: DataFrame, time: str, width: str, step: str, late: str | None = None) -> DataFrame:
    """As tumbling, of windows that begin every `step`: a row counts in each window it lies in."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, width, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(rows: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Counts and sums of `value` by key and session: rows less than `gap` after the one before belong together."""
    rows = rows.withWatermark(time, late) if late else rows
    found = rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("session_window.start").alias("start"), "n", "total")


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")
