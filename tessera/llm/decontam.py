"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance, on words.

An item of m words may be found with up to k = floor(rate * m) word edits (insert, delete,
replace). It is split into k + 1 pieces; a passage within k edits holds one of them unchanged. Texts
are scanned in blocks for the rolling hashes of all pieces of each length; where one hits, the
stretch in which the item could lie is verified by Myers' algorithm, with the item's words as bits
of one integer. The benchmark is a stated query set: it is read in blocks of about `block_items`,
each sent to all executors and run against all documents, one block after the other (a scan of the
documents for each).

Words are runs of letters and digits, lower-cased. Defined results: null and empty texts or items,
and items of fewer than `min_words` words, match nothing; items with equal texts are each reported;
rows that repeat are each reported; other columns of either table are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import BLOCK_BYTES, U64, Rolling, blocks, mix, stored
from tessera.llm.sieve import joined

RATE, MIN_WORDS, BLOCK_ITEMS = 0.2, 5, 20_000
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 ranges that cover m words evenly."""
    cuts = [m * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


class Items:
    """Test items and the hashes of their pieces; sent to executors whole."""

    def __init__(self, rows: list[tuple], rate: float, min_words: int):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        texts = [(i, w) for i, w in ((i, tokens(t)) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))) if len(w) >= min_words]
        for item, words in texts:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            self.items.append((item, ids, int(rate * len(ids))))
        for at, (_, ids, budget) in enumerate(self.items):
            rolling = Rolling(self.values(np.array(ids, dtype=np.int64)))
            for a, b in pieces(len(ids), budget):
                self.pieces[b - a][int(rolling.ranges(np.array([a]), np.array([b]))[0])].append((at, a))
        self.pieces = {n: dict(found) for n, found in self.pieces.items()}
        self.sorted = {n: np.sort(np.fromiter(found, dtype=np.uint64, count=len(found))) for n, found in self.pieces.items()}

    @staticmethod
    def values(ids: np.ndarray) -> np.ndarray:
        return mix(ids.astype(U64) + U64(1))

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def bits(self, at: int) -> dict[int, int]:
        where: dict[int, int] = defaultdict(int)
        for i, w in enumerate(self.items[at][1]):
            where[w] |= 1 << i
        return dict(where)

    def best(self, at: int, text: list[int]) -> tuple[int, int]:
        """Least distance of the item to any stretch of the text, and the first place at which one that near ends."""
        bits, m = self.bits(at), len(self.items[at][1])
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, least, end = full, 0, m, m, 0
        for i, w in enumerate(text):
            eq = bits.get(w, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(across | plus)), plus & across
            score += bool(up & top) - bool(down & top)
            if score < least:
                least, end = score, i
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
        return least, end

    def hits(self, ids: np.ndarray):
        """(place, item, place in the item) of each piece found in a block of word ids; 0 is no item's word."""
        rolling, known = Rolling(self.values(ids)), np.concatenate([[0], np.cumsum(ids > 0)])
        for n, there in self.sorted.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            hashes = rolling.ranges(at, at + n)
            spot = np.minimum(np.searchsorted(there, hashes), len(there) - 1)
            for i in np.flatnonzero(there[spot] == hashes):
                for item, a in self.pieces[n][int(hashes[i])]:
                    yield int(at[i]), item, a

    def search(self, texts: list[list[str]]):
        """(text, item, distance, first, last word of the stretch that was searched up to the match) of the best match in each text."""
        get = self.words.get
        lengths = np.array([len(t) + 1 for t in texts])
        ids = np.zeros(int(lengths.sum()), dtype=np.int64)
        ends = np.cumsum(lengths)
        for t, end in zip(texts, ends, strict=True):
            ids[end - 1 - len(t) : end - 1] = [get(w, 0) for w in t]
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for place, item, a in self.hits(ids):
            doc = int(np.searchsorted(ends, place, side="right"))
            low, high = int(ends[doc] - lengths[doc]), int(ends[doc]) - 1
            _, words, budget = self.items[item]
            spans[doc, item].append((max(low, place - a - budget), min(high, place - a + len(words) + budget)))
        for (doc, item), found in sorted(spans.items()):
            low, best = int(ends[doc] - lengths[doc]), None
            found.sort()
            merged = [list(found[0])]
            for s, e in found[1:]:
                if s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                distance, end = self.best(item, ids[s:e].tolist())
                if distance <= self.items[item][2] and (best is None or distance < best[0]):
                    best = distance, max(s, s + end - len(self.items[item][1]) + 1) - low, s + end - low
            if best:
                yield doc, item, *best


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, first_word, last_word): a row per document and item found in it."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n_blocks = max(1, -(-items.count() // block_items))
    kind = items.schema["item_id"].dataType
    arrow = to_arrow_type(kind)
    schema = docs.select("doc_id").schema.add("item_id", kind).add("distance", "integer").add("first_word", "long").add("last_word", "long")
    out = None
    for b in range(n_blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(Items(rows, rate, min_words))

        def run(batches, sent=sent):
            known = sent.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for i, j in blocks([len(t or "") for t in texts], BLOCK_BYTES):
                    found = list(known.search([tokens(t) for t in texts[i:j]])) if known.items else []
                    if found:
                        doc, item, *rest = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array([i + d for d in doc]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([known.items[x][0] for x in item], arrow), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])], schema.names)

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
        if n_blocks > 1:  # one block at a time is held by the driver and the executors
            part = stored(part)
            sent.unpersist()
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))  # ids may be null or shared
    found = matches(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), benchmark, **options)
    found = stored(found.select(F.col("doc_id").alias("key"), F.lit(True).alias("hit")).distinct())
    return joined(keyed, found).where("hit is null").select("row.*")
