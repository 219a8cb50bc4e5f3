"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the text's shingle hashes have it; more than 64 bits
are drawn by mixing each hash further. Equal fingerprints are merged first. The bits are cut into
segments, each looked up under every value of a small Hamming ball around it (of two fingerprints the
one with the smaller segment value looks up the other), and complete distances verify what meets.

With 64 bits the scheme is exact: fingerprints that differ in at most `distance` bits differ in at most
distance // segments bits of some segment. The number of segments is taken from the number of
fingerprints: the more there are, the longer the segments, so that chance meetings stay few.

Wide fingerprints, over distinct shingles, serve to find texts by similarity. The share of bits in which
two of them agree is 1 - arccos(cosine of their shingle sets) / pi, so a similarity has its distance. 96
keys of two bytes each (whatever the size of the input) bring together pairs of similarity 0.8 with a
probability of about 0.995, and more similar ones more surely; candidates may differ by four standard
deviations more than such pairs do on the mean. What candidates connect is then compared by the
Jaccard similarity of the shingle sets themselves (as 64-bit hashes): only that makes links. Texts of
fewer than ten words meet a little less surely (about 0.95 for four of five shingles).

Defined results: a null or empty text has fingerprint zero and links like any other; rows that
repeat share fingerprint and component; a null doc_id is never a component's name unless all are null.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, encoded, mix, stored
from tessera.llm.components import components, stars
from tessera.llm.sieve import joined

SEED = 42
#: Fingerprints up to which 64 bits are cut into so many segments; into two beyond.
SEGMENTS = {1 << 24: 3}
#: Bits of wide fingerprints, and of those that go along with each key to measure distances.
WIDE, SKETCH = 512, 256
#: Keys of a wide fingerprint are its bytes at two places, which differ by one of these in binary.
PARTNERS = (1, 37, 22)
#: Up to so many rows under one key all pairs are compared; above, a search that drops what it has reached.
SMALL = 32
#: Rows under one key up to which a task holds them all; more are cut into blocks of about so many, compared by twos.
GROUP = 1 << 14
#: Texts in a block whose shingle sets are compared; a task holds two blocks of a group at most.
BLOCK = 512


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        rows = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return out


def shingles(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, dtype=U64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) > width else [words]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(b" ".join(run), SEED) for run in runs]), dtype=">u8").astype(U64)


def fingerprint(text: bytes, width: int, bits: int = 64) -> list[int]:
    """Words of 64 bits each, as signed numbers."""
    hashes = shingles(text, width)
    if not len(hashes):
        return [0] * (bits // 64)
    if bits > 64:
        hashes = np.unique(hashes)
    sums = [bit_sums(hashes if i == 0 else mix(hashes + U64(i))) for i in range(bits // 64)]
    return [int.from_bytes(np.packbits(2 * s > len(hashes)).tobytes(), "big", signed=True) for s in sums]


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, text: str = "text") -> DataFrame:
    """The columns of docs without the text, and fp: the fingerprint's 64-bit words."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*kept, F.array(F.lit(0).cast("long")).alias("fp")).schema

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width, bits) for t in encoded(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*kept, "fp"])

    return docs.select(*kept, F.col(text).cast("string")).mapInArrow(run, schema)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_in_group(nodes: np.ndarray, fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all fingerprints of a large group within the distance: a breadth-first
    search in which each step compares with what has not been reached yet."""
    nodes, first = np.unique(nodes, return_index=True)
    fps, left, one, other = fps[first], np.arange(1, len(first)), [], []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        near = differing(fps[left], fps[x]) <= distance
        found = left[near]
        if len(found):
            one.append(np.full(len(found), nodes[x]))
            other.append(nodes[found])
            queue.extend(found.tolist())
            left = left[~near]
    return one, other


def verified(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, distance: int):
    """Links between nodes of rows, sorted by key, that share a key and lie within the distance."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    small, one, other = np.repeat(sizes <= SMALL, sizes), [], []
    for step in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(at):
            break
        at = at[differing(fps[at], fps[at + step]) <= distance]
        one.append(nodes[at])
        other.append(nodes[at + step])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = near_in_group(nodes[bounds[g] : bounds[g + 1]], fps[bounds[g] : bounds[g + 1]], distance)
        one += a
        other += b
    if one:
        yield np.concatenate(one), np.concatenate(other)


def looked_up(distinct: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """(key, node, fp) of each segment's values; a segment is (first bit, bits) and lies in one word."""
    rows = None
    for s, (first, size) in enumerate(segments):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(size), r)]
        word = F.element_at("fp", first // 64 + 1)
        own = distinct.select("node", "fp", F.shiftrightunsigned(word, first % 64).bitwiseAND((1 << size) - 1).alias("own"))
        ball = F.transform(F.array(*map(F.lit, masks)).cast("array<long>"), lambda mask: F.col("own").bitwiseXOR(mask))
        found = own.select(F.explode(F.filter(ball, lambda value: value >= F.col("own"))).alias("value"), "node", "fp").select((F.col("value") * len(segments) + s).alias("key"), "node", "fp")
        rows = found if rows is None else rows.union(found)
    return rows


def wide_keys(distinct: DataFrame, bits: int) -> DataFrame:
    """(key, node, fp) of each pair of bytes; fp is cut to the bits that measure distances.

    The pairs are rows to explode, not columns each: a plan of 96 expressions takes hundreds of MB in the driver."""
    size = bits // 8
    pairs = [(a, a ^ step) for step in PARTNERS for a in range(size) if a < a ^ step]
    rows = distinct.select(F.posexplode(F.lit([a * size + b for a, b in pairs])).alias("s", "pair"), "node", "fp")

    def byte(b: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.element_at("fp", F.shiftright(b, 3) + 1), b % 8 * 8).bitwiseAND(255)

    key = (byte(F.floor(F.col("pair") / size).cast("int")) * 256 + byte(F.col("pair") % size)) * len(pairs) + F.col("s")
    return rows.select(key.alias("key"), "node", F.slice("fp", 1, SKETCH // 64).alias("fp"))


def bounded(rows: DataFrame) -> DataFrame:
    """rows with large keys cut into blocks: a row goes once to each pair of its own and another block, so any two meet."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    blocks, first = F.ceil(F.col("n") / GROUP), F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.transform(F.sequence(first, blocks - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    keys = F.when(F.col("n").isNull(), F.array("key")).otherwise(pairs)
    return rows.join(F.broadcast(sizes), "key", "left").select(F.explode(keys).alias("key"), "node", "fp")


def links(distinct: DataFrame, distance: int, bits: int = 64) -> DataFrame:
    """Links (a, b) between nodes of (node, fp) that connect what the segments bring together within the
    distance. Of wide fingerprints it is the distance in the first SKETCH bits."""
    n = distinct.count()
    if bits == 64:
        count = next((m for most, m in SEGMENTS.items() if n <= most), 2)
        cuts = [64 * s // count for s in range(count + 1)]
        rows = looked_up(distinct, [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], distance // count)
    else:
        rows = wide_keys(distinct, bits)
    if n > GROUP:
        rows = bounded(rows)
    held = min(bits, SKETCH) // 64

    def found(batches):
        keys, nodes, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, held), dtype=U64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                nodes = np.concatenate([nodes, batch.column(1).to_numpy()])
                fps = np.concatenate([fps, batch.column(2).flatten().to_numpy().view(U64).reshape(-1, held)])
            # the last key may go on in the next batch
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from verified(keys[:cut], nodes[:cut], fps[:cut], distance)
                keys, nodes, fps = keys[cut:], nodes[cut:], fps[cut:]

    def run(batches):
        for a, b in stars(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def distance_of(similarity: float, bits: int = SKETCH) -> int:
    """Bits in which hardly any pair of fingerprints differs whose shingle sets have this Jaccard
    similarity: four standard deviations above the mean."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def alike(nodes: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect all sets of a group whose Jaccard similarity is as high: a breadth-first search
    in which each step compares with what has not been reached yet."""
    one, other, sizes = [], [], np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    mark, left, queue = np.zeros(len(ids) + 1, dtype=bool), np.ones(len(sets), dtype=bool), []
    while left.any():
        if not queue:
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
        x = queue.pop()
        own = ids[ends[x] - sizes[x] : ends[x]]
        mark[own] = True
        common = np.bincount(owner[mark[ids]], minlength=len(sets))
        mark[own] = False
        # in whole numbers of millionths, as 0.8 is no binary fraction
        near = np.flatnonzero(left & (common * 1_000_000 >= round(similarity * 1_000_000) * (sizes + sizes[x] - common)))
        left[near] = False
        one += [nodes[x]] * len(near)
        other += [nodes[y] for y in near]
        queue += near.tolist()
    return one, other


def similar(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the nodes of (root, node, text) with one root and a shingle similarity as high.

    A large root's nodes are cut into blocks; a task holds those of two blocks."""
    sizes = texts.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    count = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    dealt = texts.join(F.broadcast(sizes), "root", "left").withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.select("root", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "node", "text")

    def found(batches):
        group, nodes, sets = None, [], []
        for batch in itertools.chain(batches, [None]):
            read = [] if batch is None else zip(*(batch.column(i).to_pylist() for i in range(4)), encoded(batch.column(4)), strict=True)
            for *key, node, text in itertools.chain(read, [(None, None, None, None, b"")] if batch is None else []):
                if key != group:
                    if len(nodes) > 1:
                        a, b = alike(nodes, sets, similarity)
                        yield np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                    group, nodes, sets = key, [], []
                if batch is not None:
                    nodes.append(node)
                    sets.append(np.unique(shingles(text, width)))

    def run(batches):
        for a, b in stars(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    names = ["root", "low", "high"]
    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, bits: int = 64) -> DataFrame:
    """One row per document: its other columns, fp and component_id, the least doc_id reachable over links.

    Columns of docs that have one of these names, or are named node, are left out."""
    docs = docs.select(*(c for c in docs.columns if c not in ("node", "component_id")))
    marked = stored(fingerprints(docs, width, bits, text).withColumn("node", F.xxhash64("fp") if bits > 64 else F.element_at("fp", 1)))
    distinct = stored(marked.groupBy("node").agg(F.min(doc_id).alias("least_id"), F.first("fp").alias("fp")))
    of = rooted(distinct, components(links(distinct.select("node", "fp"), distance, bits)))
    names = of.join(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id")
    return marked.join(names, "node").drop("node")


def rooted(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(node, least_id, root): the root that components found, or the node itself."""
    found = found.withColumnRenamed("node", "linked")
    return distinct.join(found, distinct["node"] == found["linked"], "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, bits: int = WIDE) -> DataFrame:
    """The documents left when one of each group of near-duplicates stays: the one of the least doc_id (a null
    one last), and of rows that share it one that a hash of the text decides. Their columns are those of docs."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(doc_id, text).alias("key"))
    marked = fingerprints(keyed.select(f"row.{doc_id}", "key", f"row.{text}"), width, bits, text)
    marked = stored(marked.withColumn("node", F.xxhash64("fp")))
    distinct = stored(marked.groupBy("node").agg(F.min(doc_id).alias("least_id"), F.first("fp").alias("fp"), F.min("key").alias("key")))
    near = components(links(distinct.select("node", "fp"), distance_of(similarity), bits)).withColumnRenamed("node", "linked")
    chosen = distinct.join(near, distinct["node"] == near["linked"]).select("key", F.struct("node", "root").alias("of"))
    texts = joined(keyed.select("key", F.col(f"row.{text}").cast("string").alias("text")), stored(chosen)).where("of is not null")
    texts = stored(texts.dropDuplicates(["key"]).select("of.root", "of.node", "text"))
    found = rooted(distinct, components(similar(texts, width, similarity))).select("node", "root")
    # by root: ids may be null or shared by unlike texts
    rows = stored(marked.groupBy("key", "node").agg(F.min(doc_id).alias("id"), F.count("*").alias("n")).join(found, "node"))
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")).select(F.col("least.key").alias("key"), F.lit(True).alias("stays"))
    # rows to drop, and rows that repeat in full and share a key: one of those stays
    marks = stored(rows.join(chosen, "key", "left").where("stays is null or n > 1").select("key", F.coalesce("stays", F.lit(False)).alias("stays")))
    marked = joined(keyed, marks)
    return marked.where("stays is null").unionByName(marked.where("stays").dropDuplicates(["key"])).select("row.*")
