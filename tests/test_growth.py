"""What steps move and hold grows no faster than their input."""

import random

import numpy as np
import pytest

from tessera import errors
from tessera.llm import components, simhash
from tessera.plans import catalog, ranges
from tessera.queries import QUERIES
from tessera.sources import classic


def stages(spark):
    """What the stages so far have moved, the last one first."""
    java = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = store.stageList(None, False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
    return [listed.apply(i) for i in range(listed.size())]


def moved(spark, run):
    """Rows that a run writes to shuffles."""
    before = {s.stageId() for s in stages(spark)}
    run()
    return sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before)


def test_dimensions_of_one_group_of_many_scales(spark):
    n, m = 1000, 300
    axes = spark.range(2 * n).selectExpr("'f' AS file", "'/g' AS path", "id div 2 AS variable", "id % 2 AS axis", "4L AS length", "false AS unlimited", "if(id % 6 = 1, id % 20, null) AS reference")
    scales = spark.range(m).selectExpr("'f' AS file", "id AS address", "'/g' AS path", "concat('s', id) AS name", "4L AS length", "false AS unlimited")
    found = []
    rows = moved(spark, lambda: found.extend(catalog.dimensioned(axes, scales).collect()))
    names = {}
    for r in sorted(found, key=lambda r: (r["variable"], r["axis"])):
        names.setdefault(r["variable"], []).append(r["dimension"])
    assert len(found) == 2 * n
    for v, own in names.items():
        if v % 3 == 0:  # the second axis refers to a scale, the first takes the least that is free
            taken = f"s{(2 * v + 1) % 20}"
            assert own == ["s1" if taken == "s0" else "s0", taken]
        else:
            assert own == ["s0", "s1"]
    assert rows < 10 * (2 * n + m)


def merged(rows, gap):
    """Ranges merged one after the other, by file."""
    out, last = [], {}
    for file, offset, length in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        run = last.get(file)
        if run and offset - run[2] <= gap:
            run[2], run[3] = max(run[2], offset + length), run[3] + 1
        else:
            last[file] = run = [file, offset, offset + length, 1]
            out.append(run)
    return sorted(((f, low, high - low, n) for f, low, high, n in out), key=str)


@pytest.mark.parametrize("width", [1, 50, 1000, 1 << 26])
def test_ranges_are_merged_over_stretches(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-500, 5000), rng.choice([0, 1, 5, 20, 900])) for _ in range(300)]
    rows += [("long", 0, 3000)] + [("long", i * 40, 2) for i in range(100)] + [("alone", 7, 0)]
    table = spark.createDataFrame(rows, "file string, offset long, length long")
    for gap in (0, 7, 60):
        assert sorted(map(tuple, ranges.coalesced(table, "file", gap, width).collect()), key=str) == merged(rows, gap)
    assert ranges.coalesced(table.limit(0), "file", 7, width).count() == 0


def test_ranges_of_one_file_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 1000, raising=False)
    rows = spark.range(40_000).selectExpr("'f' AS file", "id * 8192 AS offset", "10L AS length")
    before = {s.stageId() for s in stages(spark)}
    assert ranges.coalesced(rows, "file", 0).count() == 40_000
    tasks = [s for s in stages(spark) if s.stageId() not in before and s.shuffleReadRecords() >= 40_000]
    assert max(s.numTasks() for s in tasks) >= 40
    assert {r["file"] for r in ranges.requests(rows, "file", 0, 1).collect()} == {"f"}


def test_variables_of_a_file_are_read_in_one_pass(spark):
    variables = [("event", [0], ">i8", {}, np.arange(5)), ("user", [0], ">i4", {}, np.arange(5) * 2), ("grid", [0, 1], ">f8", {}, np.arange(10).reshape(5, 2) / 4)]
    content = classic.written(5, [("event", 0), ("level", 2)], {}, variables, 5)
    found = spark.createDataFrame([("a.nc", content), ("b.nc", content)], "path string, content binary")
    rows = sorted(map(tuple, classic.together(found, {"event": ">i8", "user": ">i4"}, ["e"]).collect()))
    assert rows == [(p, i, i, 2 * i) for p in ("a.nc", "b.nc") for i in range(5)]
    assert classic.cells(found, "event", ">i8", ["event"]).columns == ["path", "event", "value"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20
    with pytest.raises(Exception, match=errors.TypeMismatch.__name__):
        classic.together(found, {"event": ">i8", "grid": ">f8"}, ["event"]).collect()
    plan = QUERIES["q_record_2d_interleaved"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("n", [300, 1200])
def test_links_of_one_group_of_near_copies(spark, n):
    rng = random.Random(n)
    base, rows = rng.getrandbits(512), []
    for node in rng.sample(range(1 << 40), n):
        fp = base
        for b in rng.sample(range(512), rng.randint(10, 60)):
            fp ^= 1 << b
        rows.append((node, [(fp >> 64 * w & (1 << 64) - 1) - (1 << 63) for w in range(8)]))
    found = simhash.links(spark.createDataFrame(rows, "node long, fp array<long>"), simhash.distance_of(0.8), 512).collect()
    assert all(r["a"] < r["b"] for r in found)
    assert len({r["b"] for r in found}) == n - 1
    assert len(found) < 8 * n


def test_stars_connect_what_links_do(monkeypatch):
    monkeypatch.setattr(components, "HELD", 20)
    rng = np.random.default_rng(1)
    for size in (10, 200, 2000):
        lists = [rng.integers(0, size, (2, rng.integers(0, 30))) for _ in range(12)]

        def roots(pairs):
            root = {i: i for i in range(size)}
            for a, b in pairs:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
            return root

        given = [tuple(p) for a, b in lists for p in zip(a.tolist(), b.tolist())]
        found = [p for a, b in components.stars((a, b) for a, b in lists) for p in zip(a.tolist(), b.tolist())]
        assert all(a < b for a, b in found)
        assert roots(found) == roots(given)
    assert list(components.stars([])) == []
