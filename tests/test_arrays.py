import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import BadRequest, Malformed, Unsupported
from tessera.functions import codecs
from tessera.operators import chunks
from tessera.operators.chunks import Layout
from tessera.operators.selection import Slab, one_value
from tessera.plans import catalog, ranges
from tessera.sources import classic
from tessera.streaming import windows


def test_extents():
    assert Slab.of((4, 5)) == Slab((0, 0), (4, 5))
    assert Slab.of((4, 5), 1, slice(2, None)) == Slab((1, 2), (1, 3))
    assert Slab.of((4, 5), (1, 2, "inclusive"), ...) == Slab((1, 0), (2, 5))
    assert Slab.of((), *()) == Slab((), ()) and Slab((), ()).elements == 1
    for bad in [(5, None), (slice(0, 6), None), (slice(3, 1), None), (0,)]:
        with pytest.raises(BadRequest):
            Slab.of((4, 5), *bad)
    with pytest.raises(Unsupported):
        Slab.of((4,), slice(0, 4, 2))
    with pytest.raises(BadRequest):
        Slab.start_count((4,), (1,), (4,))
    with pytest.raises(BadRequest):
        one_value(None, Slab((0,), (2,)), ["x"])


@pytest.mark.parametrize("filters", [(), (codecs.SHUFFLE, codecs.DEFLATE, codecs.FLETCHER32), (codecs.ZSTD,)])
@pytest.mark.parametrize("kind", ["<i4", ">i4"])
def test_chunks_round_trip(spark, filters, kind):
    shape = Layout(("y", "x"), (40, 6), (7, 4), kind, filters, -1)
    rows = spark.range(240).select((F.col("id") / 6).cast("long").alias("y"), (F.col("id") % 6).alias("x"), (3 * F.col("id") - 100).alias("value"))
    stored = chunks.encoded(rows, shape)
    assert stored.count() == 12
    found = {(r["y"], r["x"]): r["value"] for r in chunks.cells(stored, shape).collect()}
    assert found == {(k // 6, k % 6): 3 * k - 100 for k in range(240)}
    slab = Slab.start_count(shape.shape, (5, 2), (10, 3))
    part = chunks.cells(stored, shape, slab)
    assert {(r["y"], r["x"]) for r in part.collect()} == {(y, x) for y in range(5, 15) for x in range(2, 5)}
    assert chunks.missing(stored, shape).count() == 0


def test_chunks_never_written_hold_the_fill_value(spark):
    shape = Layout(("y", "x"), (8, 8), (4, 4), "<i4", (), -7)
    rows = spark.range(16).select((F.col("id") / 4).cast("long").alias("y"), (F.col("id") % 4).alias("x"), F.col("id").alias("value"))
    stored = chunks.encoded(rows, shape)
    assert {r["value"] for r in chunks.filled(stored, shape, Slab.of(shape.shape, slice(5, 7), slice(5, 7))).collect()} == {-7}
    found = {(r["y"], r["x"]): r["value"] for r in chunks.filled(stored, shape).collect()}
    assert found == {(y, x): 4 * y + x if y < 4 and x < 4 else -7 for y in range(8) for x in range(8)}
    cut = stored.withColumn("payload", F.substring("payload", 1, 10))
    with pytest.raises(Exception, match="a chunk of 10 bytes"):
        chunks.cells(cut, shape).collect()


def test_pruning_reaches_the_chunk_scan(spark, tmp_path):
    shape = Layout(("y", "x"), (40, 6), (7, 4), "<i4")
    rows = spark.range(240).select((F.col("id") / 6).cast("long").alias("y"), (F.col("id") % 6).alias("x"), F.col("id").alias("value"))
    chunks.encoded(rows, shape).write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    plan = chunks.cells(stored, shape, Slab.of(shape.shape, 3, None))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(chunk_y" in plan and "LessThanOrEqual(chunk_y" in plan


def fixture(version):
    label = np.array([list(x.ljust(8, b"\0")) for x in (b"surface", b"middle", b"bottom")], dtype=np.uint8).view("S1").reshape(3, 8)
    return classic.written(
        version,
        [("time", 0), ("level", 3), ("name_strlen", 8)],
        {"title": "fixture", "version": np.array([3], dtype=np.int32)},
        [
            ("time", [0], ">f8", {"units": "days since 1970-01-01"}, np.arange(4.0)),
            ("pressure", [0, 1], ">f4", {"_FillValue": np.array([-999], dtype=np.float32)}, 0.5 + np.arange(12).reshape(4, 3)),
            ("count", [1], ">i4", {}, np.array([10, 20, 30])),
            ("flag", [0, 1], ">i2", {}, 1 + np.arange(12).reshape(4, 3)),
            ("label", [1, 2], "S1", {}, label),
        ],
        4,
    )


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic_files(spark, tmp_path, version):
    (tmp_path / "a.nc").write_bytes(fixture(version))
    found = classic.files(spark, str(tmp_path), "*.nc")
    assert classic.parsed(fixture(version)).stride == 28
    assert classic.containers(found).first()["container"] == f"cdf{version}"
    assert {(r["name"], r["length"], r["unlimited"]) for r in classic.dimensions(found).collect()} == {("time", 4, True), ("level", 3, False), ("name_strlen", 8, False)}
    flag = classic.cells(found, "/flag", ">i2", ["time", "level"])
    assert {(r["time"], r["level"]): r["value"] for r in flag.collect()} == {(t, k): 1 + 3 * t + k for t in range(4) for k in range(3)}
    part = classic.cells(found, "pressure", ">f4", ["time", "level"], lambda s: Slab.of(s, slice(1, 3), 2), coordinates=True)
    assert sorted((r["time"], r["level"], r["value"], r["coord_time"]) for r in part.collect()) == [(1, 2, 5.5, 1.0), (2, 2, 8.5, 2.0)]
    names = classic.cells(found, "label", "S1", ["level", "at"])
    assert "".join(r["value"] for r in names.where("level = 1").orderBy("at").collect()) == "middle"
    own = {(r["variable"], r["name"]): r["text"] or r["numbers"] for r in classic.attributes(found).collect()}
    assert own["", "title"] == "fixture" and own["", "version"] == [3.0] and own["pressure", "_FillValue"] == [-999.0]


def test_classic_corruption():
    good = fixture(1)
    for n in [0, 1, 4, 8, 32, 64, len(good) // 8, len(good) // 4, len(good) // 2, len(good) - 4]:
        try:
            h = classic.parsed(good[:n])
            for v in h.variables:
                h.view(good[:n], v)
        except (Malformed, Unsupported, BadRequest):
            continue
        raise AssertionError(n)
    for i in range(0, len(good)):
        broken = bytearray(good)
        broken[i] ^= 0x55
        try:
            h = classic.parsed(bytes(broken))
            for v in h.variables:
                h.view(bytes(broken), v)
        except (Malformed, Unsupported, BadRequest):
            pass


def test_classic_streaming_record_count():
    content = bytearray(fixture(1))
    content[4:8] = b"\xff" * 4
    assert classic.parsed(bytes(content)).records == 4


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 2), ("a", 12, 4), ("a", 40, 1), ("b", 3, 3)], "file string, offset long, length long")
    assert sorted(tuple(r) for r in ranges.coalesced(rows, "file", 2).select("file", "offset", "length", "parts").collect()) == [("a", 0, 16, 3), ("a", 40, 1, 1), ("b", 3, 3, 1)]
    pages = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 7, 9)], "file string, page long")
    assert sorted(tuple(r) for r in ranges.islands(pages, "file", "page").collect()) == [("a", 1, 3), ("a", 7, 7), ("a", 9, 9)]


def test_catalog(spark):
    groups = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b")], "id long, parent long, name string")
    assert {r["path"] for r in catalog.paths(groups).collect()} == {"/root", "/root/a", "/root/a/b"}
    axes = spark.createDataFrame([("v", 0, 9, 4), ("v", 1, None, 4), ("v", 2, None, 4), ("w", 0, None, 4)], "variable string, axis long, reference long, length long")
    scales = spark.createDataFrame([(9, "time")], "address long, name string")
    found = {(r["variable"], r["axis"]): r["dimension"] for r in catalog.named_axes(axes, scales).collect()}
    assert found == {("v", 0): "time", ("v", 1): "phony_dim_0", ("v", 2): "phony_dim_1", ("w", 0): "phony_dim_0"}


def test_time_windows_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nc").write_bytes(fixture(2))
    cells = classic.cells(windows.new_files(spark, str(tmp_path / "in")), "pressure", ">f4", ["time", "level"], coordinates=True)
    rows = cells.select(windows.decoded_time(F.col("coord_time"), "days since 1970-01-01").cast("timestamp").alias("time"), F.col("value").cast("double").alias("value"))
    query = windows.tumbling(rows, "time", "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName("days").start()
    try:
        query.processAllAvailable()
        found = sorted((r["start"].day, r["n"], r["total"]) for r in spark.table("days").collect())
    finally:
        query.stop()
    assert found == [(1, 3, 4.5), (2, 3, 13.5), (3, 3, 22.5), (4, 3, 31.5)]
    with pytest.raises(Unsupported):
        windows.decoded_time(F.lit(1), "fortnights since 1970-01-01")
