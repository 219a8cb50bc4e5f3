"""Language-model scores of texts: the marginal probability over all segmentations into subword pieces.

The pieces and their scores are those of an existing public vocabulary. The scores are ranks; taken as a
Zipf distribution they are the first weights of the lattice. A few rounds of Spark jobs over the counted
training words then replace them by the expected number of times each piece is used over all
segmentations (forward and backward recursions, by word). A word's probability sums over all ways to
write it in pieces (a character that is no piece is written in byte pieces), by a forward recursion in
log space, for a block of words at a time. Words do not share pieces, so a text's marginal probability
is the product of its words' and that of its end.

Each distinct word of the corpus is counted and scored once, in a table by word. Texts then look up
the `head` most frequent words in a broadcast table (a fixed bound) and join the others to
that table, so that no frequent word is ever a join key. Beside it stands the add-one unigram
score of whole words.

Defined results: a null or empty text is one end token; rows that repeat are each returned;
without training rows every count is 0 and base probabilities are 1 / (V + 1); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Powers, Rolling, encoded, mix, row_key, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, SMOOTHING, ROUNDS = 1 << 16, 0.1, 3
#: Characters of the words that are scored together.
BLOCK_CHARS = 1 << 17
#: Words of so many characters are scored one by one.
LONG = 256
SPACE = "▁"
LOG10 = math.log(10)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes.lower() changes A-Z only


class Lattice:
    """Pieces with log probabilities (natural)."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float], end: float):
        self.pieces, self.bytes, self.end = pieces, bytes_, end
        self.names = list(pieces)
        self.longest = max(map(len, self.names), default=1)
        chars = np.concatenate([np.empty(0, dtype=U64), *map(code_points, self.names)])
        ends = np.cumsum([0, *map(len, self.names)])
        hashes = Rolling(mix(chars + U64(1))).ranges(ends[:-1], ends[1:])
        order = np.argsort(hashes)
        #: Pieces by hash: the number of each, and for each number its log probability; the last is that of none.
        self.hashes, self.order = hashes[order], order
        self.taken = np.zeros(1 << 18, dtype=bool)
        self.taken[hashes >> U64(46)] = True
        self.logs = np.array([*pieces.values(), -np.inf])

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash."""
        out = np.full(len(hashes), len(self.names))
        may = np.flatnonzero(self.taken[hashes >> U64(46)])  # most strings are no piece
        at = np.searchsorted(self.hashes, hashes[may])
        at[at == len(self.hashes)] = 0
        held = self.hashes[at] == hashes[may]
        out[may[held]] = self.order[at[held]]
        return out

    def spelt(self, chars: np.ndarray) -> np.ndarray:
        """Log probabilities of characters written in byte pieces."""
        kinds, back = np.unique(chars, return_inverse=True)
        return np.array([sum(self.bytes[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in kinds])[back]

    def walk(self, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the log probability over all its segmentations, by a forward recursion that takes all
        words one character further at a time. With `times`, how often each is counted, also the expected
        number of each piece and of each byte over those segmentations, by the backward recursion."""
        n = np.array([len(w) + 1 for w in words], dtype=np.int64)
        if len(words) == 1 and n[0] > LONG:
            whole, pieces, spelt = self.walk_long(words[0], None if times is None else float(times[0]))
            return np.array([whole]), pieces, spelt
        ranks = np.argsort(-n, kind="stable")  # the words that reach a place are the first ones
        n, most = n[ranks], int(n.max(initial=0))
        active = np.searchsorted(-n, -np.arange(most + 1), side="right")
        grid = np.zeros((most, len(words)), dtype=U64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grid[place, np.repeat(np.arange(len(words)), n)] = code_points("".join(SPACE + words[r] for r in ranks))
        up, down = Powers.to(most + 1)
        sums = np.zeros((most + 1, len(words)), dtype=U64)
        np.cumsum(mix(grid + U64(1)) * up[:most, None], axis=0, out=sums[1:])

        def spans(first: int, last: int, count: int) -> np.ndarray:
            """Piece numbers of the characters from first to last."""
            return self.found(mix((sums[last, :count] - sums[first, :count]) * down[first] + U64(last - first)))

        forward = np.full((most + 1, len(words)), -np.inf)
        forward[0] = 0.0
        for k in range(1, most + 1):
            count = int(active[k])
            ways = [forward[k - size, :count] + self.logs[spans(k - size, k, count)] for size in range(1, min(k, self.longest) + 1)]
            single = spans(k - 1, k, count)
            lone = single == len(self.names)
            if lone.any():
                ways.append(np.where(lone, forward[k - 1, :count] + self.spelt(grid[k - 1, :count]), -np.inf))
            forward[k, :count] = total(ways)
        whole = forward[n, np.arange(len(words))]
        pieces, spelt = np.zeros(len(self.names) + 1), np.zeros(256)
        if times is not None:
            weight = times[ranks].astype(np.float64)
            backward = np.full((most + 1, len(words)), -np.inf)
            backward[n, np.arange(len(words))] = 0.0
            for k in range(most - 1, -1, -1):
                count = int(active[k + 1])
                ways = []
                for size in range(1, min(most - k, self.longest) + 1):
                    reach = int(active[k + size])
                    which = spans(k, k + size, reach)
                    way = np.full(count, -np.inf)
                    way[:reach] = self.logs[which] + backward[k + size, :reach]
                    ways.append(way)
                    np.add.at(pieces, which, weight[:reach] * np.exp(forward[k, :reach] + way[:reach] - whole[:reach]))
                    if size == 1 and (lone := which == len(self.names)).any():
                        by = np.flatnonzero(lone)
                        way = np.full(count, -np.inf)
                        way[by] = self.spelt(grid[k, by]) + backward[k + 1, by]
                        ways.append(way)
                        share = weight[by] * np.exp(forward[k, by] + way[by] - whole[by])
                        kinds, back = np.unique(grid[k, by], return_inverse=True)
                        for c, s in zip(kinds, np.bincount(back, share), strict=True):
                            for b in chr(int(c)).encode("utf-8", "surrogatepass"):
                                spelt[b] += s
                np.logaddexp(backward[k, :count], total(ways), out=backward[k, :count])
        out = np.empty(len(words))
        out[ranks] = whole
        return out, pieces[:-1], spelt

    def walk_long(self, word: str, times: float | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The same for one word of many characters, whose pieces are looked up at all places at once."""
        chars = code_points(SPACE + word)
        n, rolling = len(chars), Rolling(mix(chars + U64(1)))
        starts, ends, which = [], [], []
        for size in range(1, min(n, self.longest) + 1):
            held = self.found(rolling.ranges(np.arange(n - size + 1), np.arange(size, n + 1)))
            at = np.flatnonzero(held < len(self.names))
            starts.append(at)
            ends.append(at + size)
            which.append(held[at])
            if size == 1:
                lone = np.flatnonzero(held == len(self.names))
                starts.append(lone)
                ends.append(lone + 1)
                which.append(np.full(len(lone), -1))
        start, end, piece = (np.concatenate(x) for x in (starts, ends, which))
        logs = self.logs[piece]
        logs[piece < 0] = self.spelt(chars[start[piece < 0]])
        order = np.argsort(end, kind="stable")
        edges = list(zip(start[order].tolist(), end[order].tolist(), logs[order].tolist(), strict=True))
        forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        forward[0] = backward[n] = 0.0
        for a, b, p in edges:
            forward[b] = added(forward[b], forward[a] + p)
        pieces, spelt = np.zeros(len(self.names)), np.zeros(256)
        if times is not None:
            order = np.argsort(-start, kind="stable")
            for a, b, p in zip(start[order].tolist(), end[order].tolist(), logs[order].tolist(), strict=True):
                backward[a] = added(backward[a], backward[b] + p)
            share = times * np.exp(np.array(forward)[start] + logs + np.array(backward)[end] - forward[n])
            np.add.at(pieces, piece[piece >= 0], share[piece >= 0])
            for a, s in zip(start[piece < 0].tolist(), share[piece < 0].tolist(), strict=True):
                for x in chr(int(chars[a])).encode("utf-8", "surrogatepass"):
                    spelt[x] += s
        return forward[n], pieces, spelt

    def word(self, text: str) -> float:
        """Log probability of a word over all its segmentations."""
        return float(self.walk([text])[0][0])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)


def added(a: float, b: float) -> float:
    """Logarithm of the sum of what two numbers are logarithms of."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def total(ways: list[np.ndarray]) -> np.ndarray:
    """Logarithm of the sum of what these are logarithms of."""
    rows = np.stack(ways)
    most = rows.max(axis=0)
    safe = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(rows - safe).sum(axis=0)) + safe


def some(words: list[str]):
    """Ranges of words with about BLOCK_CHARS characters once padded to the longest; they are sorted by length."""
    start = 0
    for i in range(len(words)):
        if i > start and ((i - start + 1) * (len(words[i]) + 1) > BLOCK_CHARS or len(words[i]) >= LONG):
            yield start, i
            start = i
    if start < len(words):
        yield start, len(words)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): training counts of every word of (text, train); 0 for those met in other texts only."""

    def run(batches):
        for batch in batches:
            learnt, met = Counter(), set()
            for text, train in zip(encoded(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if train:
                    learnt.update(words(text))
                else:
                    met.update(words(text))
            other = met.difference(learnt)
            yield pa.RecordBatch.from_arrays([pa.array([*learnt, *other], pa.binary()), pa.array([*learnt.values(), *[0] * len(other)], pa.int64())], ["word", "n"])

    return docs.select("text", "train").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice(counts: DataFrame, texts: int, vocabulary: str = VOCABULARY, smoothing: float = SMOOTHING, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities from counted training words and the number of their texts."""
    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary)  # a file of the driver; what is read from it goes to the executors
    usable = [i for i in range(own.get_piece_size()) if not own.is_control(i) and not own.is_unknown(i)]
    names = [own.id_to_piece(i) for i in usable]
    at = {p: i for i, p in enumerate(names)}
    byte = [at.get(f"<0x{b:02X}>", -1) for b in range(256)]
    spelt = set(byte)

    def model(weights: np.ndarray) -> Lattice:
        whole = float(weights.sum()) + texts + smoothing * (len(names) + 1)
        logs = np.log((weights + smoothing) / whole)
        none = math.log(smoothing / whole)
        return Lattice({p: float(logs[i]) for p, i in at.items() if i not in spelt}, [float(logs[b]) if b >= 0 else none for b in byte], math.log((texts + smoothing) / whole))

    scores = np.array([own.get_score(i) for i in usable])
    held = model(1e6 / (1.0 + scores.max() - scores))
    trained = counts.where("n > 0").select("word", "n")
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(held)  # a fixed vocabulary

        def run(batches, sent=sent):
            lattice_ = sent.value
            pieces, spelt_ = np.zeros(len(lattice_.names)), np.zeros(256)
            for batch in batches:
                rows = sorted(((w.decode(), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), key=lambda r: len(r[0]))
                words = [w for w, _ in rows]
                for i, j in some(words):
                    _, p, b = lattice_.walk(words[i:j], np.array([n for _, n in rows[i:j]]))
                    pieces += p
                    spelt_ += b
            where = np.flatnonzero(pieces)
            names_ = [lattice_.names[i] for i in where] + [f"<0x{b:02X}>" for b in range(256) if spelt_[b]]
            yield pa.RecordBatch.from_arrays([pa.array(names_, pa.string()), pa.array([*pieces[where], *spelt_[spelt_ > 0]], pa.float64())], ["piece", "n"])

        expected = np.zeros(len(names))
        for r in trained.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum(F.round("n", 6).cast("decimal(28,6)")).cast("double").alias("n")).collect():  # a row for each piece
            if r["piece"] in at:
                expected[at[r["piece"]]] = r["n"]
        held = model(expected)
    return held


def scored_words(counts: DataFrame, model: Lattice) -> DataFrame:
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            order = sorted(range(len(words)), key=lambda i: len(words[i]))
            found, ordered = np.empty(len(words)), [words[i] for i in order]
            for i, j in some(ordered):
                found[order[i:j]] = sent.value.walk(ordered[i:j])[0] / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["word", "n", "score"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, score double")


def scored(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score), a row per document; `train` is a column that marks what to learn from."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), train.alias("train"), F.col(text).cast("string").alias("text"))
    counts = stored(word_counts(rows))
    texts = rows.where("train").count()
    sums = counts.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = (sums[0] or 0) + texts, sums[1] + (texts > 0)
    whole = float(tokens + kinds + 1)
    model = lattice(counts, texts, vocabulary, rounds=rounds)
    table = stored(scored_words(counts, model))
    top = table.orderBy(F.col("n").desc(), "word").limit(head)
    frequent = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): (math.log10((r["n"] + 1) / whole), r["score"], r["n"] > 0) for r in top.collect()})
    end = math.log10((texts + 1) / whole), model.end / LOG10, texts > 0
    schema = rows.select(F.lit(0).cast("long").alias("key"), "doc_id", "train").schema.add("word", "binary").add("n", "long").add("n_known", "long").add("base", "double").add("score", "double")

    def run(batches):
        known = frequent.value
        for batch in batches:
            at, word, n, n_known, base, score = [], [], [], [], [], []
            for i, data in enumerate(encoded(batch.column(3))):
                of = Counter(words(data))
                b, s, k = end[0], end[1], int(end[2])
                for w, times in of.items():
                    found = known.get(w)
                    if found:
                        b += times * found[0]
                        s += times * found[1]
                        k += times * found[2]
                    else:
                        at.append(i)
                        word.append(w)
                        n.append(times)
                        n_known.append(0)
                        base.append(0.0)
                        score.append(0.0)
                at.append(i)
                word.append(None)
                n.append(sum(of.values()) + 1)
                n_known.append(k)
                base.append(b)
                score.append(s)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], schema.names)

    # two kinds of rows from one pass over the texts, written once and read for each kind
    each = stored(rows.select(row_key("doc_id", "text").alias("key"), "doc_id", "train", "text").mapInArrow(run, schema))
    looked = each.where("word is not null").select("key", F.col("doc_id").alias("id"), "word", F.col("n").alias("times")).join(table, "word")
    rare = looked.groupBy("key", "id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / whole)).alias("rare_base"),
        F.sum(F.col("times") * F.col("score")).alias("rare_score"),
    )
    heads = each.where("word is null")
    # rows that repeat share a key, and their rare words were counted once for each of them
    copies = heads.groupBy("key", "doc_id").agg(F.count("*").alias("copies"), F.first("train").alias("train"), *(F.first(c).alias(c) for c in ("n", "n_known", "base", "score")))
    part = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0))
    out = copies.join(rare.withColumnRenamed("key", "of"), F.expr("key = of and doc_id <=> id"), "left").select(
        "doc_id",
        "train",
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + part("rare_known").cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + part("rare_base")).alias("base_score"),
        (F.col("score") + part("rare_score")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
