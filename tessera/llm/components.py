"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Links that a task holds to find those that say nothing new.
HELD = 1 << 18


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) do, one for each node but the least of its component: (least, node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, one, other = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(one):
        low, high = np.minimum(root[one], root[other]), np.maximum(root[one], root[other])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[one] != root[other]
        one, other = one[apart], other[apart]
    left = np.flatnonzero(root != np.arange(len(root)))
    return nodes[root[left]], nodes[left]


def stars(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of several lists, each node's to the least one that it reaches within the task: groups that share
    nodes give one link for each of those, not one for each group."""
    one, other, n = [], [], 0
    for a, b in found:
        one.append(a)
        other.append(b)
        n += len(a)
        if n > HELD:
            a, b = star(np.concatenate(one), np.concatenate(other))
            one, other, n = [a], [b], len(a)
            if 2 * n > HELD:
                yield a, b
                one, other, n = [], [], 0
    if n:
        yield star(np.concatenate(one), np.concatenate(other))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for each node of a link between two different nodes; root is the least node reachable.

    Each round hangs every larger neighbour of a node on the least one (large star), then every
    smaller neighbour (small star); it ends when no link changes. Only counts come to the driver.
    Links of a null node and of a node to itself are left out; an empty table gives an empty one.
    """
    edges = stored(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
