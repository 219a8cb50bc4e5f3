"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings of 4 letters, all of those in the examples. Fitting reads at most
`examples` labelled rows, those with the least hash of their id (a documented bound: they and what is made
of them are the only data that reach the driver). Document frequencies of the terms are counted over all
documents. A term's inverse document frequency is multiplied by its relevance factor, log2(1 + r), where r
is how much more often toxic examples hold the term than clean ones do, drawn towards 1 where few hold it
(the tf.rf weighting of text categorisation): it is 1 for a term that says nothing and never 0, so every
text with a word in common with an example has neighbours.

Each example's unit vector goes into an inverted index whose postings are cut into blocks of examples,
with the greatest weight of each term in each block. A text's rare terms are added up over all their
postings; its frequent terms where they matter, in those blocks whose greatest sum so far and greatest weights could
still reach the k nearest, so no nearer example is missed. The distance-weighted vote of the k nearest is
mapped to a probability by a logistic curve fitted on the examples, each voted on by the others; texts
that share no term with any example get the share of toxic ones among such examples.

Defined results: a null or empty text has no terms and gets that share; with no labelled rows
every score is 0; a document labelled twice counts as toxic if any of its labels is, and of documents
that share an id the least text is learned from; a row that repeats is scored each time; of examples
equally near the one that stands first in the index counts; other columns of either table are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fold, given_back, stored
from tessera.llm.sieve import joined

EXAMPLES, NEAREST, POSTING_BLOCK = 4096, 15, 64
#: Terms in more than this share of the examples are frequent: their postings are kept as rows of a matrix.
FREQUENT = 1 / 16
#: Examples by which a term's relevance is drawn towards none.
PRIOR = 20.0
TOKEN = re.compile(r"[^\W\d_]+")
BEGINNING = 4
#: The Latin-1 characters in lower case, those that are in no token as blanks.
LATIN = bytes(ord(c) if TOKEN.fullmatch(c) else 0x20 for c in (chr(b).lower() for b in range(256)))


def tokens(text: str | None) -> list[str]:
    """The tokens of the text in lower case. Latin-1 texts are cut at blanks, several times faster than by the pattern."""
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split() if text else []
    except UnicodeEncodeError:
        return TOKEN.findall(text.lower())


def terms_of(word: str) -> tuple[str, ...]:
    return (word, f"{word[:BEGINNING]}*") if len(word) > BEGINNING else (word,)


class Counted:
    """The known terms of texts, in ascending order, and how often each stands there."""

    def __init__(self, terms: dict[str, int]):
        self.words, self.beginnings = terms, {t[:-1]: i for t, i in terms.items() if t.endswith("*")}
        #: The beginning of each known word that is longer.
        self.begun = np.full(len(terms) + 1, -1, dtype=np.int64)
        self.begun[np.fromiter(terms.values(), dtype=np.int64, count=len(terms))] = [self.begin(t) for t in terms]

    def begin(self, word: str) -> int:
        return self.beginnings.get(word[:BEGINNING], -1) if len(word) > BEGINNING else -1

    def terms(self, words: list[str]) -> np.ndarray:
        """Each word as a term, then each word's beginning; -1 for what is not known."""
        own = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        begun, new = self.begun[own], np.flatnonzero(own < 0)
        begun[new] = [self.begin(words[i]) for i in new.tolist()]
        return np.concatenate([own, begun])

    def distinct(self, text: str | None) -> np.ndarray:
        """The known terms alone, in no order."""
        words = list(set(tokens(text)))
        held = self.terms(words)
        own, begun = held[: len(words)], held[len(words) :]
        return np.concatenate([own[own >= 0], np.unique(begun[begun >= 0])])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        times = Counter(tokens(text))
        held = self.terms(list(times))
        n = np.tile(np.fromiter(times.values(), dtype=np.int64, count=len(times)), 2)
        terms, back = np.unique(held[held >= 0], return_inverse=True)
        return terms, np.bincount(back, n[held >= 0], minlength=len(terms)).astype(np.int64)


def terms_and_counts(counts) -> tuple[np.ndarray, np.ndarray]:
    """Of a dictionary, or of the two arrays themselves."""
    if isinstance(counts, dict):
        return np.fromiter(counts.keys(), dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    return counts


class Index:
    """Unit TF-IDF vectors of the examples as block-max postings; `idf` is the weight of each term."""

    def __init__(self, idf: np.ndarray, examples: list[tuple], nearest: int):
        self.idf, self.nearest = idf, nearest
        examples = [(i, toxic, *terms_and_counts(counts)) for i, toxic, counts in examples]
        # examples with like vectors share blocks, which makes the bounds tight
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (-e[1], int(e[2][np.argmax(self.vector(e[2:])[1])]), e[0]))
        self.ids = [e[0] for e in examples]
        self.toxic = np.array([e[1] for e in examples], dtype=np.float64)
        terms = np.concatenate([np.empty(0, dtype=np.int64), *(e[2] for e in examples)])
        order = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.places = np.repeat(np.arange(len(examples), dtype=np.int32), [len(e[2]) for e in examples])[order]
        self.times = np.concatenate([np.empty(0, dtype=np.int64), *(e[3] for e in examples)])[order].astype(np.int32)
        self.weigh()

    def __getstate__(self) -> dict:
        """What is sent: weights and the matrix of frequent terms are made again where they are used."""
        return {k: v for k, v in self.__dict__.items() if k not in ("weights", "matrix", "most", "row")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weigh()

    def weigh(self) -> None:
        n = len(self.ids)
        terms = np.repeat(np.arange(len(self.idf)), np.diff(self.starts))
        raw = (1 + np.log(self.times)) * self.idf[terms]
        lengths = np.sqrt(np.bincount(self.places, raw * raw, minlength=n)) if n else np.empty(0)
        self.weights = raw / np.where(lengths > 0, lengths, 1.0)[self.places]
        self.blocks = -(-n // POSTING_BLOCK)
        many = np.flatnonzero(np.diff(self.starts) > max(POSTING_BLOCK, FREQUENT * n))
        self.row = np.full(len(self.idf), -1, dtype=np.int64)
        self.row[many] = np.arange(len(many))
        self.matrix = np.zeros((len(many), self.blocks, POSTING_BLOCK), dtype=np.float32)
        for r, t in enumerate(many):
            at = slice(self.starts[t], self.starts[t + 1])
            self.matrix[r].reshape(-1)[self.places[at]] = self.weights[at]
        self.most = self.matrix.max(axis=2, initial=0.0)

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        terms, times = terms_and_counts(counts)
        raw = (1 + np.log(times)) * self.idf[terms]
        return terms, raw / (math.sqrt(float(raw @ raw)) or 1.0)

    def unit(self, counts) -> list[tuple[int, float]]:
        terms, weights = self.vector(counts)
        return list(zip(terms.tolist(), weights.tolist(), strict=True))

    def near(self, counts, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples, the nearest first; `but` is left out."""
        terms, weights = self.vector(counts)
        if not len(terms) or not self.blocks:
            return np.empty(0, dtype=np.int64), np.empty(0)
        rows = self.row[terms]
        rare, rows, frequent = rows < 0, rows[rows >= 0], weights[rows >= 0].astype(np.float32)
        first, sizes = self.starts[terms[rare]], self.starts[terms[rare] + 1] - self.starts[terms[rare]]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        sums = np.bincount(self.places[at], weights=np.repeat(weights[rare], sizes) * self.weights[at], minlength=self.blocks * POSTING_BLOCK).astype(np.float64)
        if but >= 0:
            sums[but] = -2.0
        # what is known so far of the k-th nearest; a block that cannot reach it holds none of them
        least = max(0.0, np.partition(sums, len(sums) - self.nearest)[len(sums) - self.nearest]) if len(sums) > self.nearest else 0.0
        sums = sums.reshape(self.blocks, POSTING_BLOCK)
        bounds = sums.max(axis=1) + frequent @ self.most[rows]
        left = np.flatnonzero(bounds * (1 + 1e-5) >= least)
        if 3 * len(left) > self.blocks:  # whole rows are read faster than most of their blocks
            sums += (frequent @ self.matrix[rows].reshape(len(rows), sums.size)).reshape(sums.shape)
        else:
            sums[left] += (frequent @ self.matrix[rows[:, None], left].reshape(len(rows), len(left) * POSTING_BLOCK)).reshape(len(left), -1)
        sums = sums.reshape(-1)
        if len(sums) > self.nearest:
            least = max(least, np.partition(sums, len(sums) - self.nearest)[len(sums) - self.nearest])
        cells = np.flatnonzero((sums > 0) & (sums >= least))
        order = np.argsort(-sums[cells], kind="stable")[: self.nearest]
        return cells[order], sums[cells[order]]

    def vote(self, counts, but: int = -1) -> tuple[float, float, np.ndarray] | None:
        """Share of toxic neighbours weighted by nearness, the nearest cosine, and the neighbours."""
        places, scores = self.near(counts, but)
        if not len(places):
            return None
        weights = 1 / (1.1 - np.minimum(scores, 1.0))
        return float(weights @ self.toxic[places] / weights.sum()), float(scores[0]), places


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a ridged logistic fit, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + 0.05 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


class Model:
    """sent: the broadcast terms and index; ids of its examples; none: score of texts that share no term; beta: the calibration, if any."""

    def __init__(self, sent, ids: list, none: float, beta: np.ndarray | None = None):
        self.sent, self.ids, self.none, self.beta = sent, ids, none, beta


def score(index: Index, counts, none: float, beta: np.ndarray | None) -> tuple[float, list]:
    voted = index.vote(counts)
    if voted is None or beta is None:
        return none, []
    z = float(beta @ np.array([1.0, voted[0], voted[0] * voted[1]]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [index.ids[p] for p in voted[2]]


def sample(docs: DataFrame, labels: DataFrame, folds: int | None, examples: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows to learn from."""
    rows = labels.where("doc_id is not null and toxic is not null")
    if folds:
        rows = rows.where(fold(folds) != 0)
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # at most `examples` rows of two values
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def frequencies(docs: DataFrame, terms: dict[str, int], text: str = "text") -> np.ndarray:
    """Of how many documents each term is one; the last number is that of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        counted, held = Counted(sent.value), np.zeros(len(sent.value) + 1, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held[counted.distinct(t)] += 1
                held[-1] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "n"])

    out = np.zeros(len(terms) + 1, dtype=np.int64)
    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    sent.unpersist()
    return out


def relevance(examples: list[tuple], terms: int, prior: float = PRIOR) -> np.ndarray:
    """log2(1 + r) of each term, r being the smoothed odds of toxic examples among those that hold it by those among all."""
    held = np.zeros((2, terms))
    for _, toxic, counts in examples:
        held[toxic, terms_and_counts(counts)[0]] += 1
    share = sum(e[1] for e in examples) / max(1, len(examples))
    if not 0 < share < 1:
        return np.ones(terms)
    return np.log2(1 + (held[1] + prior * share) / (held[0] + prior * (1 - share)) * (1 - share) / share)


def fitted(docs: DataFrame, labels: DataFrame, folds: int | None = None, examples: int = EXAMPLES, nearest: int = NEAREST) -> Model:
    rows = sample(docs, labels, folds, examples)
    known: dict[str, int] = {}
    read = rows.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    read = sorted((r["doc_id"], r["toxic"], r["text"]) for r in read)
    for _, _, text in read:
        for w in set(tokens(text)).difference(known):
            for t in terms_of(w):
                known.setdefault(t, len(known))
    counted = Counted(known)
    found = [(doc_id, toxic, counted(text)) for doc_id, toxic, text in read]
    df = frequencies(docs, known)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) * relevance(found, len(known))
    index = Index(idf, found, nearest)
    none = [toxic for _, toxic, counts in found if not len(counts[0])]
    sent = docs.sparkSession.sparkContext.broadcast((known, index))  # at most `examples` vectors
    model = Model(sent, index.ids, (sum(none) / (len(none) + 2)) if found else 0.0)
    del read, known, counted, found, index
    given_back()

    def votes(batches):
        terms, held = sent.value
        counted, at = Counted(terms), {d: i for i, d in enumerate(held.ids)}
        for batch in batches:
            got = []
            for doc_id, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                voted = held.vote(counted(text), at[doc_id]) if doc_id in at else None
                if voted:
                    got.append((voted[0], voted[1], toxic))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in zip(*got, strict=True)], ["vote", "nearest", "toxic"])

    spread = rows.select("doc_id", "toxic", "text").repartition(max(1, min(32, examples // 128)), "doc_id")
    voted = spread.mapInArrow(votes, "vote double, nearest double, toxic double").orderBy("vote", "nearest", "toxic").collect()
    if voted:
        model.beta = logistic(np.array([[r["vote"], r["vote"] * r["nearest"]] for r in voted]), np.array([r["toxic"] for r in voted]))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs without the text, and score, predicted and evidence (ids of the nearest examples)."""
    sent, none, beta = model.sent, model.none, model.beta
    kept = [c for c in docs.columns if c not in (text, "score", "predicted", "evidence")]
    schema = docs.select(*kept).schema
    whole = all(isinstance(i, int) for i in model.ids)
    kind = pa.int64() if whole else pa.string()
    for c, t in (("score", T.DoubleType()), ("predicted", T.IntegerType()), ("evidence", T.ArrayType(T.LongType() if whole else T.StringType()))):
        schema = schema.add(c, t)

    def run(batches):
        terms, index = sent.value
        counted = Counted(terms)
        for batch in batches:
            found = [score(index, counted(t), none, beta) for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [s for s, _ in found]
            evidence = [e if whole else [str(i) for i in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(kind))], schema.names)

    return docs.select(*kept, F.col(text).cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not called toxic. Texts go to the workers but do not come back."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    found = scored(keyed.select("key", F.col("row.text").alias("text")), model).where("predicted = 1")
    found = stored(found.select("key", F.lit(True).alias("hit")).distinct())
    return joined(keyed, found).where("hit is null").select("row.*")
