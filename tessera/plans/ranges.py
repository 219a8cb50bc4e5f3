"""Byte ranges and index arithmetic as table operations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raveled(axes: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major linear index."""
    at = F.lit(0).cast("long")
    for a, n in zip(axes, shape, strict=True):
        at = at * n + a
    return at


def unraveled(index: Column, shape: Sequence[int]) -> list[Column]:
    out: list[Column] = []
    for n in reversed(shape):
        out.insert(0, (index % n).cast("long"))
        index = F.floor(index / n)
    return out


#: Rows of a task that sorts; by so many tasks grow in number, not in size.
TASK_ROWS = 1 << 19
#: Bytes of a file whose ranges are sorted together.
STRETCH = 1 << 26


def spread(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """n rows, or fewer, dealt by the columns to tasks of about TASK_ROWS."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *by)


def coalesced(ranges: DataFrame, key: str, gap: int, width: int = STRETCH) -> DataFrame:
    """(key, offset, length, parts): of each file, ranges merged where the gap to all before is at most `gap`.

    Files are cut into stretches of `width` bytes, each given how far those before it reach. Only the first and the
    last run of each stretch, which may go on in others, are brought together by file."""
    end = F.col("offset") + F.col("length")
    rows = ranges.select(key, "offset", "length", F.floor(F.col("offset") / width).alias("stretch"))
    ends = rows.groupBy(key, "stretch").agg(F.max(end).alias("end"))
    before = F.max("end").over(Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(key, "stretch", before.alias("end"), F.lit(0).alias("side")).where("end is not null")
    both = rows.select(key, "stretch", end.alias("end"), F.lit(1).alias("side"), "offset", "length").unionByName(carried, allowMissingColumns=True)
    stretch = Window.partitionBy(key, "stretch")
    ordered = stretch.orderBy("side", "offset", "length")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when((F.col("side") == 1) & (F.col("reach").isNull() | (F.col("offset") - F.col("reach") > gap)), 1).otherwise(0)
    marked = spread(both, ranges.count(), key, "stretch").withColumn("reach", reach).withColumn("opens", opens)
    # run 0 of a stretch goes on from before
    runs = marked.withColumn("run", F.sum("opens").over(ordered)).where("side = 1").groupBy(key, "stretch", "run")
    runs = runs.agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.count("*").alias("parts"))
    runs = runs.withColumn("edge", (F.col("run") == 0) | (F.col("run") == F.max("run").over(stretch)))
    opened = F.sum(F.when(F.col("run") > 0, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("stretch", "run"))
    edges = runs.where("edge").withColumn("opened", opened).groupBy(key, "opened").agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.sum("parts").alias("parts"))
    found = runs.where("not edge").select(key, "offset", "end", "parts").union(edges.select(key, "offset", "end", "parts"))
    return found.select(key, "offset", (F.col("end") - F.col("offset")).alias("length"), "parts")


#: Gap and request size, in bytes, by where the files are.
PRESETS = {"none": (0, 0), "local": (16 << 10, 4 << 20), "remote": (1 << 20, 8 << 20)}


def requests(ranges: DataFrame, key: str, gap: int, most: int) -> DataFrame:
    """(key, offset, length, parts): of each file, sorted ranges merged one after the other while the gap to the
    request so far is at most `gap` and the request stays within `most` bytes; one longer range is a request alone.

    Ranges of a file come sorted to one task, which holds one open request a time."""
    types = ranges.select(key).schema

    def run(batches):
        file, low, high, parts = None, 0, -1, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for k, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if parts and k == file and offset - high <= gap and max(high, offset + length) - low <= most:
                    high, parts = max(high, offset + length), parts + 1
                    continue
                if parts:
                    for o, x in zip(out, (file, low, high - low, parts), strict=True):
                        o.append(x)
                file, low, high, parts = k, offset, offset + length, 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], [key, "offset", "length", "parts"])
            kind = batch.column(0).type
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([file], kind), *(pa.array([x], pa.int64()) for x in (low, high - low, parts))], [key, "offset", "length", "parts"])

    rows = ranges.select(key, F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    schema = types.add("offset", "long").add("length", "long").add("parts", "long")
    return spread(rows, ranges.count(), key).sortWithinPartitions(key, "offset", "length").mapInArrow(run, schema)


def islands(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, first, last): maximal runs of successive page numbers."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(page))
    return pages.select(key, page).distinct().withColumn("island", F.col(page) - nth).groupBy(key, "island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("island")


def overlapping(chunks: DataFrame, slabs: DataFrame, axis: str) -> DataFrame:
    """Chunks that a selection touches, as a semi-join on the chunk numbers a selection spans, not on all pairs.

    chunks: (chunk, first, count); slabs: (start, count), with every chunk of one size held in `axis`."""
    spans = slabs.select(F.explode(F.sequence(F.floor(F.col("start") / F.col(axis)), F.floor((F.col("start") + F.col("count") - 1) / F.col(axis)))).alias("chunk")).distinct()
    return chunks.join(spans, "chunk", "left_semi")
