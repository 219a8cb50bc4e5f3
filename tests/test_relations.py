"""Joins by order, dimension rules and merged requests against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import codecs
from tessera.operators import joins
from tessera.operators.selection import Slab
from tessera.plans import catalog, ranges


@pytest.mark.parametrize("width", [1.0, 7.0, 1e9])
def test_as_of_and_nearest(spark, width):
    rng = random.Random(1)
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *map(float, range(40))])) for i in range(80)]
    right = [(rng.choice([1, 2, None]), float(rng.randint(0, 40)), i) for i in range(30)]
    lefts = spark.createDataFrame(left, "id int, by int, at double")
    rights = spark.createDataFrame(right, "by int, at double, v int")
    best = {}
    for by, at, v in right:
        best[by, at] = max(v, best.get((by, at), -1))
    found = {r["id"]: (r["v"], r["matched"]) for r in joins.as_of(lefts, rights, "by", "at", ["v"], width).collect()}
    ahead = {r["id"]: r["matched"] for r in joins.as_of(lefts, rights, "by", "at", ["v"], width, forward=True).collect()}
    near = {r["id"]: (r["v"], r["matched"]) for r in joins.nearest(lefts, rights, "by", "at", ["v"], width).collect()}
    for i, by, at in left:
        there = sorted(t for b, t in best if b == by and b is not None and at is not None)
        back, next_ = [t for t in there if t <= at], [t for t in there if t >= at]
        assert found[i] == ((best[by, back[-1]], back[-1]) if back else (None, None))
        assert ahead[i] == (next_[0] if next_ else None)
        close = min(there, key=lambda t: (abs(t - at), t), default=None)
        assert near[i] == ((best[by, close], close) if there else (None, None))
    assert joins.as_of(lefts, rights.limit(0), "by", "at", ["v"], width).where("v is not null").count() == 0


def test_dimensions_are_numbered_by_group(spark):
    axes = [("/edges", "empty_a", 0, 0, False), ("/edges", "empty_b", 0, 0, False), ("/edges", "fixed_three", 0, 3, False), ("/edges", "growable", 0, 3, True), ("/outer/inner", "six", 0, 6, False), ("/outer", "flat", 0, 4, False)]
    axes += [("/outer", "pair", 0, 6, False), ("/outer", "pair", 1, 4, False), ("/outer", "square", 0, 4, False), ("/outer", "square", 1, 4, False), ("", "top", 0, 6, False)]
    rows = [("f", *a, None) for a in axes] + [("f", "/scaled", "uses_scale", 0, 4, False, 9), ("f", "/scaled", "loose", 0, 4, False, None)]
    table = spark.createDataFrame(rows, "file string, path string, variable string, axis int, length long, unlimited boolean, reference long")
    scales = spark.createDataFrame([("f", 9, "/scaled", "row", 4, False)], "file string, address long, path string, name string, length long, unlimited boolean")
    found = {(r["variable"], r["axis"]): r["dimension"] for r in catalog.dimensioned(table, scales).collect()}
    numbers = {k: int(v.rsplit("_", 1)[1]) for k, v in found.items() if v.startswith("phony")}
    assert numbers == {("empty_a", 0): 1, ("empty_b", 0): 2, ("fixed_three", 0): 3, ("growable", 0): 4, ("six", 0): 5, ("flat", 0): 6, ("pair", 0): 7, ("pair", 1): 6, ("square", 0): 6, ("square", 1): 8, ("top", 0): 9}
    assert found["uses_scale", 0] == found["loose", 0] == "row"
    assert catalog.dimensioned(table.limit(0), scales).count() == 0


def test_paths_of_deep_and_broken_trees(spark):
    deep = spark.createDataFrame([(i, i - 1 if i else None, f"g{i}") for i in range(70)], "id int, parent int, name string")
    assert catalog.paths(deep).agg(F.max("depth")).first()[0] == 69
    with pytest.raises(errors.Malformed):
        catalog.paths(spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 2, "c")], "id int, parent int, name string"))


def test_requests_stay_within_their_size(spark):
    rows = spark.createDataFrame([("f", 0, 10), ("f", 12, 10), ("f", 30, 50), ("f", 85, 3), ("g", 5, 200), ("g", 205, 1)], "file string, offset long, length long")
    found = sorted(map(tuple, ranges.requests(rows, "file", 8, 60).collect()))
    assert found == [("f", 0, 22, 2), ("f", 30, 58, 2), ("g", 5, 200, 1), ("g", 205, 1, 1)]
    assert ranges.requests(rows.limit(0), "file", *ranges.PRESETS["remote"]).count() == 0


def test_errors_by_kind(spark):
    with pytest.raises(errors.OutOfBounds):
        Slab.of((3,), slice(0, 4))
    packed = codecs.encode(b"abcdefgh", [codecs.FLETCHER32], 1)
    with pytest.raises(errors.ChecksumMismatch):
        codecs.decode(packed[:-1] + b"\0\1"[-1:], [codecs.FLETCHER32], 1, 8)
    for f in (codecs.DEFLATE, codecs.ZSTD):
        assert codecs.decode(codecs.encode(b"x" * 100, [f], 1), [f], 1, 100) == b"x" * 100
        with pytest.raises(errors.Malformed):
            codecs.decode(codecs.encode(b"x" * 200, [f], 1), [f], 1, 100)
    heap = spark.createDataFrame([(1, 1, "v")], "collection int, item int, value string")
    with pytest.raises(Exception, match="Malformed"):
        catalog.resolved(spark.createDataFrame([(1, 2, 1)], "collection int, item int, length int"), heap).collect()


def test_selections_reach_the_scan(spark):
    from tessera.queries import QUERIES

    found = QUERIES["q_slab_block"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "chunk_vec_id" in pushed and "chunk_d" in pushed
