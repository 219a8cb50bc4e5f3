"""Rectangular selections of array axes, as filters on index columns that prune chunks too."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import BadRequest, OutOfBounds, Unsupported


@dataclass(frozen=True)
class Slab:
    """start and count of each axis."""

    start: tuple[int, ...]
    count: tuple[int, ...]

    @staticmethod
    def of(shape: Sequence[int], *extents) -> Slab:
        """Extents by axis: an index (the axis stays, with one element), a slice, a range (its end
        included if written as (first, last, "inclusive")), or None or ... for the whole axis. None at all: everything."""
        if not extents:
            extents = (None,) * len(shape)
        if len(extents) != len(shape):
            raise BadRequest(f"{len(extents)} extents for {len(shape)} axes")
        start, count = [], []
        for size, e in zip(shape, extents, strict=True):
            if e is None or e is Ellipsis:
                a, b = 0, size
            elif isinstance(e, int):
                a, b = e, e + 1
            elif isinstance(e, tuple):
                a, b = e[0], e[1] + 1
            else:
                if (e.step if e.step is not None else 1) != 1:
                    raise Unsupported("a stride other than 1")
                a, b = (e.start if e.start is not None else 0), (e.stop if e.stop is not None else size)
            if a > b:
                raise BadRequest(f"range {a}..{b} runs backwards")
            start.append(a)
            count.append(b - a)
        return Slab(tuple(start), tuple(count)).checked(shape)

    @staticmethod
    def start_count(shape: Sequence[int], start: Sequence[int], count: Sequence[int]) -> Slab:
        if not len(start) == len(count) == len(shape):
            raise BadRequest("start and count need one number for each axis")
        return Slab(tuple(start), tuple(count)).checked(shape)

    def checked(self, shape: Sequence[int]) -> Slab:
        for size, a, n in zip(shape, self.start, self.count, strict=True):
            if a < 0 or n < 0 or a + n > size:
                raise OutOfBounds(f"{a}..{a + n} is not within 0..{size}")
        return self

    @property
    def elements(self) -> int:
        return prod(self.count)

    def filter(self, axes: Sequence[str]) -> Column:
        tests = [(F.col(x) >= a) & (F.col(x) < a + n) for x, a, n in zip(axes, self.start, self.count, strict=True)]
        return reduce(lambda p, q: p & q, tests, F.lit(True))

    def chunk_filter(self, axes: Sequence[str], chunk: Sequence[int]) -> Column:
        """On chunk coordinates: the chunk shares a cell with the selection."""
        tests = [(F.col(x) >= a // c) & (F.col(x) <= (a + n - 1) // c) for x, a, n, c in zip(axes, self.start, self.count, chunk, strict=True)]
        return reduce(lambda p, q: p & q, tests, F.lit(all(self.count)))


def one_value(cells: DataFrame, slab: Slab, axes: Sequence[str]) -> DataFrame:
    """The single cell of a selection of one element."""
    if slab.elements != 1:
        raise BadRequest(f"the selection holds {slab.elements} elements, not one")
    return cells.where(slab.filter(axes))
