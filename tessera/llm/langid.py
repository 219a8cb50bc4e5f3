"""Language identification by interpolated Kneser-Ney character models.

One model of orders 1 to 4 is learned for each language over words padded with a space on either
side. Its n-gram probabilities and context weights lie in arrays sorted by 64-bit hash and are
found by binary search. A text's languages are ranked by cross-entropy per character; the margin
between the best two, with the number of characters, gives a probability by a logistic curve
fitted on documents kept from learning, and texts below a half are marked as rejected.

Fitting reads about `per_language` documents of each language, drawn by a hash of the id (a documented
bound on the sample; every language is learned). Every text is scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn
from every text is; ties go to the lesser language name; rows that repeat are judged one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, blocks, mix, stored
from tessera.llm.toxicity import logistic

ORDER, DISCOUNT, PER_LANGUAGE, CACHE = 4, 0.75, 3000, 200_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def positions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words in a row, and each one's place in its word."""
    joined = "".join(f" {w} " for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    return chars, np.arange(len(chars)) - np.repeat(starts, sizes)


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order n, the hash of the n characters that end at each position (0 where a word has fewer before it)."""
    chars, place = positions(words)
    values = mix(chars + U64(1))
    out = [values]
    for n in range(2, ORDER + 1):
        longer = np.zeros_like(values)
        longer[1:] = mix(out[-1][:-1] * U64(3) + values[1:])  # the n - 1 characters before, then this one
        longer[place < n - 1] = 0
        out.append(longer)
    return out, place


class Table:
    """Numbers found by hash."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its number."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.numbers[at]


class KneserNey:
    """Interpolated probabilities from rows (order, gram, context, shorter gram, shorter context, count), one per seen n-gram."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, ...]]):
        self.grams: dict[int, Table] = {}
        self.weights: dict[int, Table] = {}
        symbols = max(1, len(rows[1][0])) if 1 in rows else 1
        self.floor = 1.0 / (symbols + 1)
        for n in range(1, ORDER + 1):
            if n not in rows:
                continue
            gram, context, shorter, count = rows[n]
            if n < ORDER and n + 1 in rows:
                # lower orders count in how many contexts a gram goes on to the left
                heads, kinds = np.unique(rows[n + 1][2], return_counts=True)
                seen, left = Table(heads, kinds).get(gram)
                count = np.where(seen, left, 1)
            contexts, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, count)
            kinds = np.bincount(back)
            weight = DISCOUNT * kinds / total
            if n == 1:
                lower = np.full(len(gram), self.floor)
            else:
                seen, lower = self.grams[n - 1].get(shorter)
                lower = np.where(seen, lower, self.floor)
            self.grams[n] = Table(gram, np.maximum(count - DISCOUNT, 0) / total[back] + weight[back] * lower)
            self.weights[n] = Table(contexts, weight)

    def log_probabilities(self, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Of the character at each position, natural logarithms."""
        p = np.full(len(place), self.floor)
        for n in range(1, ORDER + 1):
            if n not in self.grams:
                break
            deep = place >= n - 1
            known, value = self.grams[n].get(hashes[n - 1])
            context = np.zeros(len(place), dtype=U64)
            if n > 1:
                context[1:] = hashes[n - 2][:-1]
            there, weight = self.weights[n].get(context)
            p = np.where(deep & known, value, np.where(deep & there, weight * p, p))
        return np.log(p)


class Identifier:
    def __init__(self, names: list[str], models: list[KneserNey]):
        self.names, self.models, self.beta = names, models, None
        self.at: dict[str, int] = {}
        self.costs = np.empty((0, len(names)))

    def learn_words(self, words: set[str]) -> None:
        """Have the costs of these words at hand, with those of earlier ones while they are few."""
        fresh = sorted(words.difference(self.at))
        if len(self.at) + len(fresh) > len(self.costs):
            self.at, fresh = {}, sorted(words)
            self.costs = np.empty((max(CACHE, len(fresh)), len(self.names)))
        for i in range(0, len(fresh), 1 << 14):
            some, first = fresh[i : i + (1 << 14)], len(self.at)
            hashes, place = gram_hashes(some)
            starts = np.flatnonzero(place == 0)
            for k, model in enumerate(self.models):
                each = -model.log_probabilities(hashes, place)
                each[starts] = 0  # the space before a word is given
                self.costs[first : first + len(some), k] = np.add.reduceat(each, starts)
            self.at.update(zip(some, range(first, first + len(some)), strict=True))

    def features(self, texts: list[str | None]) -> list[tuple[int, float, float] | None]:
        """Of each text the language of the lowest cross-entropy per character, the margin to the next, and that times the root of the length."""
        out: list = []
        for i, j in blocks([len(t or "") for t in texts]):
            tokens = [LETTERS.findall(t.lower()) if t and self.names else [] for t in texts[i:j]]
            self.learn_words(set().union(*tokens))
            for words in tokens:
                if not words:
                    out.append(None)
                    continue
                chars = sum(map(len, words)) + len(words)
                costs = self.costs[np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0) / chars
                best = int(np.argmin(costs))
                margin = float(np.delete(costs, best).min() - costs[best]) if len(costs) > 1 else 1.0
                out.append((best, margin, margin * chars**0.5))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        beta = self.beta if self.beta is not None else np.array([0.0, 1.0, 1.0])
        out = []
        for found in self.features(texts):
            if found is None:
                out.append((UNKNOWN, 0.0))
            else:
                z = float(beta @ np.array([1.0, *found[1:]]))
                out.append((self.names[found[0]], float(1 / (1 + np.exp(-np.clip(z, -30, 30))))))
        return out


COUNTED = "lang int, n int, gram long, context long, shorter long, count long"


def counted(batches):
    """N-gram counts of a batch of (text, lang)."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            of: dict[str, int] = {}
            for text, own in zip(texts, langs, strict=True):
                if own == lang:
                    for w in LETTERS.findall((text or "").lower()):
                        of[w] = of.get(w, 0) + 1
            if not of:
                continue
            hashes, place = gram_hashes(list(of))
            sizes = np.fromiter((len(w) + 2 for w in of), dtype=np.int64, count=len(of))
            times = np.repeat(np.fromiter(of.values(), dtype=np.int64, count=len(of)), sizes)
            for n in range(1, ORDER + 1):
                at = np.flatnonzero(place >= max(1, n - 1))
                _, first, back = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
                held = at[first]
                context = hashes[n - 2][held - 1] if n > 1 else np.zeros(len(held), dtype=U64)
                shorter = hashes[n - 2][held] if n > 1 else np.zeros(len(held), dtype=U64)
                longs = [pa.array(x.view(np.int64)) for x in (hashes[n - 1][held], context, shorter)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), lang, dtype=np.int32)), pa.array(np.full(len(held), n, dtype=np.int32)), *longs, pa.array(np.bincount(back, times[at]).astype(np.int64))], ["lang", "n", "gram", "context", "shorter", "count"])


def fitted(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier:
    """Learns from (doc_id, text, lang)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    names = sorted(r["lang"] for r in most)
    if not names:
        return Identifier([], [])
    number = {x: i for i, x in enumerate(names)}
    rate = F.create_map(*[F.lit(x) for r in most for x in (r["lang"], min(1.0, per_language / r["n"]))])
    code = F.create_map(*[F.lit(x) for x, i in number.items() for x in (x, i)])
    drawn = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)) < F.try_element_at(rate, F.col("lang"))
    kept = rows.where(drawn).select("text", F.try_element_at(code, F.col("lang")).alias("lang"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("apart"))
    kept = stored(kept)
    counts = kept.where("not apart").select("text", "lang").mapInArrow(counted, COUNTED)
    table = counts.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.sum("count").alias("count")).toArrow().to_pandas()
    models = []
    for k in range(len(names)):
        own = table[table["lang"] == k]
        models.append(KneserNey({n: (*(g[c].to_numpy().view(U64) for c in ("gram", "context", "shorter")), g["count"].to_numpy()) for n, g in own.groupby("n")}))
    found = Identifier(names, models)
    sent = kept.sparkSession.sparkContext.broadcast(found)

    def judged(batches):
        for batch in batches:
            got = [(int(f[0] == own), f[1], f[2]) for f, own in zip(sent.value.features(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True) if f]
            if got:
                right, margin, wide = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(right, pa.int32()), pa.array(margin, pa.float64()), pa.array(wide, pa.float64())], ["good", "margin", "wide"])

    apart = kept.where("apart").select("text", "lang").mapInArrow(judged, "good int, margin double, wide double").toPandas()
    if len(apart) and 0 < apart["good"].mean() < 1:
        found.beta = logistic(apart[["margin", "wide"]].to_numpy(), apart["good"].to_numpy())
    return found


def identified(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """The columns of docs without the text, and lang_pred, score and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    kept = [c for c in docs.columns if c not in (text, *added)]
    schema = docs.select(*kept).schema
    for c, kind in added.items():
        schema = schema.add(c, kind)

    def run(batches):
        for batch in batches:
            found = sent.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < 0.5 for _, s in found])], schema.names)

    return docs.select(*kept, F.col(text).cast("string")).mapInArrow(run, schema)
