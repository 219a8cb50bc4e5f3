"""Repeated stretches of at least L symbols across all texts: the common part of the two substring operators.

Comparing every suffix of the corpus would move many times its size. Instead each text names
anchors: the places whose run of k symbols has the least hash among the L - k + 1 such runs of some
window of L symbols. What a window names depends on its content alone, so two equal windows name
anchors at the same place in them. Suffixes are therefore compared only from anchors on, and only
from those whose run occurs twice or more:

1. each text gives its anchors with a hash of their surroundings (up to L - k symbols to the left, L
   to the right, as far as the text goes); equal surroundings are counted together before and after
   the shuffle, so copies of whole texts cost one row each task;
2. of anchors with several different surroundings, one example of each is fetched (a Bloom filter of
   fixed size keeps most other texts from moving), partitioned by anchor and sorted by its right side: a suffix array. A scan of it (see `scan`) gives each
   surroundings' longest reach to the left and right that another shares;
3. anchors with more than `group` different surroundings are not gathered: their partition is split by longer
   prefixes until its parts fit (`lengthened`), or by whole windows at once (`windows`); what is then still
   too large agrees on a whole window and is only counted;
4. reaches go back to the occurrences by their two hashes and are merged in each text.

`repeat_groups` gives the repeats themselves, each with all its occurrences.

Hashes have 64 bits each for the anchor and its surroundings; of words in surroundings, 48.

Defined results: an empty table, and texts shorter than the window, give no spans; rows that repeat are each
other's copies; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Rolling, blocks, encoded, stored
from tessera.llm.sieve import marked

NO_RUN = U64(0xFFFFFFFFFFFFFFFF)
#: Surroundings that one task compares at once: at 800 bytes each, under 100 MB with all that is made of them.
GROUP = 1 << 15


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols. values: of a block of texts, the 64-bit symbol values with an array
    of each text's end; code: bytes by which a symbol stands in surroundings (its value, shortened); split: how
    anchors with very many surroundings are handled."""

    values: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    code: int
    window: int
    run: int
    split: Callable[[DataFrame, Symbols, int], DataFrame]


def sliding_least(x: np.ndarray, width: int, none) -> np.ndarray:
    """Least of each `width` successive numbers, from least-so-far within chunks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, none, dtype=x.dtype)
    padded[: len(x)] = x
    chunks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(chunks, axis=1).reshape(-1)
    back = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchors(rolling: Rolling, ends: np.ndarray, window: int, run: int) -> np.ndarray:
    """Places of the anchors in a block of texts; no run or window crosses an end."""
    n = int(ends[-1]) if len(ends) else 0
    if n < window:
        return np.empty(0, dtype=np.int64)
    hashes = np.minimum(rolling.grams(run), NO_RUN - U64(1))
    starts, width = np.concatenate([[0], ends[:-1]]), window - run + 1
    crossing = np.zeros(n + 1, dtype=np.int32)  # runs that start in the last run - 1 symbols of a text
    np.add.at(crossing, np.maximum(starts, ends - run + 1), 1)
    np.add.at(crossing, ends, -1)
    bad = np.cumsum(crossing[:-1])[: len(hashes)] > 0
    hashes[bad] = NO_RUN
    least = sliding_least(hashes, width, NO_RUN)
    crossing = np.zeros(n + 1, dtype=np.int32)
    np.add.at(crossing, np.maximum(starts, ends - window + 1), 1)
    np.add.at(crossing, ends, -1)
    least[np.cumsum(crossing[:-1])[: len(least)] > 0] = 0
    # the greatest least of the windows that hold a run is the run's own hash if it is the least of one of them
    pad = np.full(width - 1, NO_RUN, dtype=U64)
    most = ~sliding_least(np.concatenate([pad, ~least, pad]), width, NO_RUN)
    return np.flatnonzero((hashes == most[: len(hashes)]) & (hashes != NO_RUN))


def left_reach(places: np.ndarray, starts: np.ndarray, s: Symbols) -> np.ndarray:
    return np.minimum(places - starts, s.window - s.run)


OCCURRENCES = ["anchor", "around", "before", "after", "place"]


def occurrences(texts: DataFrame, s: Symbols) -> DataFrame:
    """(key, anchor, around, before, after, place) of each anchor in the texts (key, text)."""

    def run(batches):
        for batch in batches:
            data = encoded(batch.column(1))
            for i, j in blocks([len(t) for t in data]):
                values, ends = s.values(data[i:j])
                rolling = Rolling(values)
                at = anchors(rolling, ends, s.window, s.run)
                if not len(at):
                    continue
                doc = np.searchsorted(ends, at, side="right")
                starts = np.concatenate([[0], ends[:-1]])
                before, after = left_reach(at, starts[doc], s), np.minimum(ends[doc] - at, s.window)
                around = rolling.ranges(at - before, at + after) + before.astype(U64) * U64(0x9E3779B97F4A7C15)
                numbers = [pa.array(x) for x in (rolling.ranges(at, at + s.run).view(np.int64), around.view(np.int64), before.astype(np.int32), after.astype(np.int32), (at - starts[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), *numbers], ["key", *OCCURRENCES])

    return texts.select("key", "text").mapInArrow(run, "key long, anchor long, around long, before int, after int, place int")


def surroundings(wanted: DataFrame, s: Symbols) -> DataFrame:
    """(anchor, around, times, before, left, right) of the wanted places of each text; left runs outwards."""

    def run(batches):
        for batch in batches:
            data = encoded(batch.column(0))
            lists = batch.column(1).to_pylist()
            for i, j in blocks([len(t) for t in data], 1 << 18):
                out: list[list] = [[] for _ in range(5)]
                values, ends = s.values(data[i:j])
                starts = np.concatenate([[0], ends[:-1]])
                raw = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - s.code :])
                for k, places in enumerate(lists[i:j]):
                    own = raw[starts[k] : ends[k]]
                    for p in places:
                        at = p["place"]
                        out[0].append(p["anchor"])
                        out[1].append(p["around"])
                        out[2].append(p["times"])
                        out[3].append(own[max(0, at - s.window + s.run) : at][::-1].tobytes())
                        out[4].append(own[at : at + s.window].tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.binary()) for x in out[3:])], ["anchor", "around", "times", "left", "right"])

    return wanted.mapInArrow(run, "anchor long, around long, times long, left binary, right binary")


def table_of(values: list[bytes], code: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol strings as rows of a matrix, each symbol one element, and their lengths."""
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // code
    width = max(1, int(lengths.max(initial=0)))
    flat = np.zeros((len(values), width * code), dtype=np.uint8)
    for i, v in enumerate(values):
        flat[i, : len(v)] = np.frombuffer(v, dtype=np.uint8)
    if code == 1:
        return flat, lengths
    wide = np.zeros((len(values), width, 8), dtype=np.uint8)
    wide[:, :, :code] = flat.reshape(len(values), width, code)
    return wide.view(np.uint64)[:, :, 0], lengths


def common(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(a_len, b_len))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """LCP intervals (first, last, depth) of a sorted list, by a stack over the common beginnings of neighbours."""
    stack: list[list[int]] = []  # [first, depth]
    for i, depth in enumerate([*lcp.tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            yield first, i - 1, deep
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append([first, depth])


def reach_in_group(lefts: list[bytes], left: np.ndarray, left_len: np.ndarray, lcp: np.ndarray, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Longest reaches (left, right) that each member of a sorted group shares with another in a repeat of a window or more.

    In an interval of depth r, members repeat a window together if they also agree on the last L - r
    symbols to the left. Members are therefore sorted by their left sides once; in each interval
    neighbours in that order show how far each one's left side is shared, and where their left sides
    differ earlier, no repeat holds them together.
    """
    n = len(left_len)
    far, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order = sorted(range(n), key=lefts.__getitem__)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    longest = common(left[order[1:]], left_len[order[1:]], left[order[:-1]], left_len[order[:-1]]).max()
    for first, last, depth in intervals(lcp, max(s.run, s.window - int(longest))):
        own = np.arange(first, last + 1)
        own = own[np.argsort(rank[own])]
        shared = common(left[own[1:]], left_len[own[1:]], left[own[:-1]], left_len[own[:-1]])
        most = np.maximum(np.concatenate([shared, [-1]]), np.concatenate([[-1], shared]))
        good = most + depth >= s.window
        at = own[good]
        far[at] = np.maximum(far[at], most[good])
        right[at] = np.maximum(right[at], depth)
    return far, right


def groups_in(lefts: list[bytes], left: np.ndarray, left_len: np.ndarray, right_len: np.ndarray, times: np.ndarray, lcp: np.ndarray, s: Symbols) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, left, right) of each maximal repeat of a window or more in a sorted group.

    An interval of depth r is scanned again by its members' left sides: those that share l symbols there, and no
    more, repeat l + r symbols. Where they all lie in one deeper interval, that one gives them. Surroundings that
    occur several times as they stand are a repeat too, unless others share them whole."""
    order = sorted(range(len(left_len)), key=lefts.__getitem__)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    alone = times > 1
    for first, last, depth in intervals(lcp, s.run):
        own = np.arange(first, last + 1)
        own = own[np.argsort(rank[own])]
        shared = common(left[own[1:]], left_len[own[1:]], left[own[:-1]], left_len[own[:-1]])
        for a, b, far in intervals(shared, max(s.window - depth, 0)):
            members = own[a : b + 1]
            if lcp[members.min() : members.max()].min() == depth:
                alone[members[(left_len[members] == far) & (right_len[members] == depth)]] = False
                yield members, far, depth
    for i in np.flatnonzero(alone & (left_len + right_len >= s.window)):
        yield np.array([i]), int(left_len[i]), int(right_len[i])


def content(left: bytes, right: bytes, far: int, depth: int, code: int) -> int:
    """64 bits of a repeat's symbols, by which it is known whichever anchor found it."""
    outwards = np.frombuffer(left[: far * code], dtype=np.uint8).reshape(-1, code)
    return int.from_bytes(xxhash.xxh64_digest(outwards[::-1].tobytes() + right[: depth * code]), "big", signed=True)


#: What a scan gives: each surroundings' longest reaches, or the repeats with the surroundings that hold them.
REACHES = "anchor long, around long, far int, right int"
GROUPS = f"repeat long, {REACHES}"


def scan(rows: DataFrame, s: Symbols, part: str = "anchor", groups: bool = False) -> DataFrame:
    """REACHES or GROUPS of (part, anchor, around, times, left, right): a part's rows meet in one task, sorted by
    the right side, and are scanned part by part."""

    def parts(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches):
        waiting: list[list[tuple]] = []
        for group in itertools.chain(parts(batches), [None]):
            if group is not None:
                waiting.append(group)
            if waiting and (group is None or sum(map(len, waiting)) >= 2048):
                yield from (repeated if groups else reached)(waiting)
                waiting = []

    def sides(members):
        left, left_len = table_of([m[4] for m in members], s.code)
        right, right_len = table_of([m[5] for m in members], s.code)
        return left, left_len, right_len, np.minimum(common(right[1:], right_len[1:], right[:-1], right_len[:-1]), s.window)

    def reached(waiting):
        members = [m for g in waiting for m in g]
        left, left_len, _, lcp = sides(members)
        out = np.full((2, len(members)), -1, dtype=np.int64)
        at = np.cumsum([0, *map(len, waiting)])
        sizes = np.diff(at)
        two = at[:-1][sizes == 2]  # most groups are pairs
        shared = common(left[two], left_len[two], left[two + 1], left_len[two + 1])
        good = shared + lcp[two] >= s.window if len(two) else np.zeros(0, dtype=bool)
        for k in (0, 1):
            out[0, two[good] + k] = shared[good]
            out[1, two[good] + k] = lcp[two[good]]
        for g in np.flatnonzero(sizes > 2):
            a, b = at[g], at[g + 1]
            out[:, a:b] = reach_in_group([m[4] for m in waiting[g]], left[a:b], left_len[a:b], lcp[a : b - 1], s)
        found = np.flatnonzero(out[0] >= 0)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([members[i][1] for i in found], pa.int64()), pa.array([members[i][2] for i in found], pa.int64()), pa.array(out[0, found].astype(np.int32)), pa.array(out[1, found].astype(np.int32))], ["anchor", "around", "far", "right"])

    def repeated(waiting):
        out: list[tuple] = []
        for group in waiting:
            left, left_len, right_len, lcp = sides(group)
            for members, far, depth in groups_in([m[4] for m in group], left, left_len, right_len, np.array([m[3] for m in group]), lcp, s):
                name = content(*group[members[0]][4:], far, depth, s.code)
                out += [(name, *group[i][1:3], far, depth) for i in members]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], ["repeat", "anchor", "around", "far", "right"])

    named = rows.select(F.col(part).alias("part"), "anchor", "around", "times", "left", "right")
    return named.repartition("part").sortWithinPartitions("part", "right", "around").mapInArrow(run, GROUPS if groups else REACHES)


def lengthened(rows: DataFrame, s: Symbols, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Parts of at most `group` rows of anchors with very many surroundings, and the rows that remain: (part,
    anchor, around, times, left, right, far, deep), those of a part agreeing on `far` symbols to the left and
    `deep` to the right.

    Suffixes start `far` symbols before the anchor. A part that is too large is halved by what a shared window can
    be: either it goes on further to the right, and the prefix grows there, or it does not, and then starts further to
    the left. So prefixes grow until a part fits or is a whole window; rows alone in a part go, but for those that occur several times
    as they stand."""
    level = rows.select("anchor", "around", "times", "left", "right", F.lit(0).alias("far"), F.lit(s.run).alias("deep"))
    fit, whole = [], []
    while True:
        half = (F.col("deep") + F.ceil((s.window - F.col("far") - F.col("deep")) / 2)).cast("int")
        ways = F.array(F.struct(F.col("far").alias("far"), half.alias("deep")), F.struct((s.window - half + 1).alias("far"), F.col("deep").alias("deep")))
        grown = level.select("anchor", "around", "times", "left", "right", F.explode(ways).alias("way")).select("anchor", "around", "times", "left", "right", "way.*")
        ends = [F.substring(side, F.lit(1), F.col(n) * s.code) for side, n in (("left", "far"), ("right", "deep"))]
        long_enough = (F.octet_length("left") >= F.col("far") * s.code) & (F.octet_length("right") >= F.col("deep") * s.code)
        grown = stored(grown.where(long_enough).select("*", F.xxhash64("anchor", "far", "deep", *ends).alias("part")))
        grown = stored(grown.join(grown.groupBy("part").agg(F.count("*").alias("n")), "part").where("n > 1 or times > 1"))
        done = F.col("far") + F.col("deep") >= s.window
        fit.append(grown.where((F.col("n") <= group) & ~done))
        whole.append(grown.where(done))
        level = grown.where((F.col("n") > group) & ~done)
        if level.isEmpty():
            return fit, whole


def by_prefixes(rows: DataFrame, s: Symbols, group: int) -> DataFrame:
    """REACHES of anchors with very many surroundings, by prefixes of varying length."""
    fit, whole = lengthened(rows, s, group)
    found = [scan(part, s, "part") for part in fit] + [w.select("anchor", "around", "far", F.col("deep").alias("right")) for w in whole]
    return reduce(DataFrame.union, found)


def windows(rows: DataFrame, s: Symbols, group: int) -> DataFrame:
    """REACHES of anchors with very many surroundings, by counting the hashes of their whole windows, of any number."""

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for anchor, around, times, left, right in zip(*cols, strict=True):
                before = len(left) // s.code
                whole = np.concatenate([np.frombuffer(left, dtype=np.uint8).reshape(-1, s.code)[::-1], np.frombuffer(right, dtype=np.uint8).reshape(-1, s.code)])
                values = np.zeros((len(whole), 8), dtype=np.uint8)
                values[:, : s.code] = whole
                values = values.view(U64)[:, 0] + U64(1)
                if len(values) < s.window:
                    continue
                rolling = Rolling(values)
                start = np.arange(len(values) - s.window + 1)
                hashes = rolling.ranges(start, start + s.window)
                n = len(start)
                for k, x in enumerate((np.full(n, anchor), np.full(n, around), np.full(n, times), before - start, hashes.view(np.int64))):
                    out[k].append(x)
                if sum(map(len, out[0])) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "around", "times", "offset", "window"])
                    out = [[] for _ in range(5)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "around", "times", "offset", "window"])

    each = rows.select("anchor", "around", "times", "left", "right").mapInArrow(run, "anchor long, around long, times long, offset long, window long")
    # a window that holds several anchors is met at each of them, but only once at one offset from one anchor
    same = ["anchor", "offset", "window"]
    often = each.groupBy(*same).agg(F.sum("times").alias("n")).where("n > 1").select(*same)
    return each.join(often, same).groupBy("anchor", "around").agg(F.max("offset").cast("int").alias("far"), (F.lit(s.window) - F.min("offset")).cast("int").alias("right"))


def compared(texts: DataFrame, s: Symbols) -> tuple[DataFrame, DataFrame]:
    """All occurrences of anchors, and the different surroundings (anchor, around, times, n, kinds, key, place,
    before, after) of those that occur twice or more, each with one example."""
    seen = stored(occurrences(texts, s))
    around = seen.groupBy("anchor", "around").agg(F.count("*").alias("times"), F.min(F.struct("key", "place", "before", "after")).alias("one"))
    several = around.groupBy("anchor").agg(F.sum("times").alias("n"), F.count("*").alias("kinds")).where("n > 1")
    return seen, stored(around.join(several, "anchor").select("anchor", "around", "times", "kinds", "one.*"))


def examples(texts: DataFrame, wanted: DataFrame, s: Symbols) -> DataFrame:
    """The wanted surroundings themselves. Rows that share a key give an example twice; it then counts twice, so that nothing changes."""
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "around", "times", "place")).alias("places"))
    marks = marked(texts.select("key", "text"), wanted.select("key")).where("possible")
    return surroundings(marks.join(asked.hint("shuffle_hash"), "key").select("text", "places"), s)


def repeated_spans(texts: DataFrame, s: Symbols, group: int = GROUP) -> DataFrame:
    """(key, spans): of each text that holds part of a repeat, the merged ranges [from, to) of symbols inside one.

    texts has a key (long) and a text; rows that share a key must be equal in full, and each counts as a text."""
    seen, kinds = compared(texts, s)
    # surroundings that occur twice as they stand are repeats as far as they go
    reaches = kinds.where((F.col("times") > 1) & (F.col("before") + F.col("after") >= s.window)).select("anchor", "around", F.col("before").alias("far"), F.col("after").alias("right"))
    reaches = reaches.union(scan(examples(texts, kinds.where((F.col("kinds") > 1) & (F.col("kinds") <= group)), s), s))
    if (kinds.agg(F.max("kinds")).first()[0] or 0) > group:
        reaches = reaches.union(s.split(stored(examples(texts, kinds.where(F.col("kinds") > group), s)), s, group))
    # written, so that the join below stands alone and Spark can split what one surroundings has too many of
    reaches = stored(reaches.groupBy("anchor", "around").agg(F.max("far").alias("far"), F.max("right").alias("right")))
    spans = seen.join(reaches, ["anchor", "around"]).select("key", F.struct((F.col("place") - F.col("far")).alias("a"), (F.col("place") + F.col("right")).alias("b")).alias("span"))
    return stored(spans.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def repeat_groups(texts: DataFrame, s: Symbols, group: int = GROUP) -> DataFrame:
    """(repeat, length, key, place): all occurrences of each maximal repeat of a window or more, which cannot be
    longer on either side without losing one of them.

    A repeat is seen from each anchor in it, L - k symbols to the left and L to the right: longer ones are given as
    overlapping stretches of that size. A window with over `group` different surroundings stands for itself. Rows
    that share a key give an occurrence once."""

    def repeats_of(whole):
        """Whole windows by name: the rows of a part agree on it, so one of them names it."""

        def run(batches):
            for batch in batches:
                names = [content(*x, s.code) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *batch.columns[:2], *batch.columns[4:]], ["repeat", "anchor", "around", "far", "right"])

        return whole.select("anchor", "around", "left", "right", "far", "deep").mapInArrow(run, GROUPS)

    seen, kinds = compared(texts, s)
    found = [scan(examples(texts, kinds.where(F.col("kinds") <= group), s), s, groups=True)]
    if (kinds.agg(F.max("kinds")).first()[0] or 0) > group:
        fit, whole = lengthened(stored(examples(texts, kinds.where(F.col("kinds") > group), s)), s, group)
        found += [scan(part, s, "part", groups=True) for part in fit]
        for rows in whole:
            found += [scan(rows.where(F.col("n") <= group), s, "part", groups=True), repeats_of(rows.where(F.col("n") > group))]
    held = stored(reduce(DataFrame.union, found).distinct())
    places = seen.join(held, ["anchor", "around"])
    return places.select("repeat", (F.col("far") + F.col("right")).alias("length"), "key", (F.col("place") - F.col("far")).alias("place")).distinct()


def merged(spans) -> list[tuple[int, int]]:
    """Maximal ranges covered by sorted ranges; those that touch are one."""
    out: list[list[int]] = []
    for span in spans or ():
        if out and span["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["b"])
        else:
            out.append([span["a"], span["b"]])
    return [(a, b) for a, b in out]
