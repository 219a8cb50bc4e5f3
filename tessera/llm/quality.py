"""Quality rules: repetition coverage of words, lines and n-grams of several lengths.

Each text is cut into words; rolling hashes of 5 to 10 words are taken over a block of texts at
once in numpy. A word is inside a duplicated n-gram when an n-gram that covers it has already
occurred earlier in the same text; the characters of such words are summed. A text fails when
that share passes the limit of its length, or when lines repeated from above pass theirs.

Defined results: a null or empty text has no words, all counts zero, and fails the base rule; rows
that repeat are judged one by one; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Rolling, BYTE_VALUE, blocks, encoded, mix, word_bounds

#: Percent of a text's word characters that may lie inside n-grams already seen in it, by n.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of lines, and of word characters in lines, that may repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 20
MIN_WORDS, REPEAT_WINDOW, REPEAT_LIMIT = 10, 5, 20

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_LIMITS)]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs twice or more, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def covered(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions inside a run of n that starts at a hit."""
    edge = np.zeros(size + 1, dtype=np.int32)
    edge[: len(hit)] += hit
    edge[n : n + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> np.ndarray:
    """Counts (rows) of each text (columns), in the order of COUNTS."""
    out = np.zeros((len(COUNTS), len(texts)), dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # past each text's closing line end
    start, end = word_bounds(data)
    doc = np.searchsorted(ends, start, side="right")
    sums = lambda mask, weight=None: np.bincount(doc[mask], weight if weight is None else weight[mask], len(texts)).astype(np.int64)
    chars_to = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = chars_to[end] - chars_to[start]
    symbols_to = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    every = np.ones(len(start), dtype=bool)
    out[0], out[1] = sums(every), sums(every, chars)
    out[2] = np.diff(symbols_to[ends], prepend=0)
    rolling = Rolling(BYTE_VALUE[data])
    salt = mix(np.arange(1, len(texts) + 1, dtype=U64))

    line_end = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    words_to = np.searchsorted(start, line_end)
    has_word = np.diff(words_to, prepend=0) > 0
    chars_in = np.diff(np.concatenate([[0], np.cumsum(chars)])[words_to], prepend=0)[has_word]
    of = np.searchsorted(ends, line_start[has_word], side="right")
    _, later = repeats(rolling.ranges(line_start[has_word], line_end[has_word]) ^ salt[of])
    out[3] = np.bincount(of[later], minlength=len(texts))
    out[5] = np.bincount(of, minlength=len(texts))
    out[6] = np.bincount(of[later], chars_in[later], len(texts))

    words = Rolling(rolling.ranges(start, end))
    for k, n in enumerate(GRAM_LIMITS):
        if len(start) < n:
            break
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        at = np.flatnonzero(inside)
        twice, later = repeats(words.grams(n)[at] ^ salt[doc[at]])
        hit = np.zeros(len(inside), dtype=np.int32)
        if n == REPEAT_WINDOW:
            hit[at] = twice
            out[4] = sums(covered(hit, n, len(start)))
        hit[at] = later
        out[7 + k] = sums(covered(hit, n, len(start)), chars)
    return out


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs (its columns other than the text) with the counts of COUNTS."""
    kept = [c for c in docs.columns if c != text and c not in COUNTS]
    schema = docs.select(*kept).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(batch.num_columns - 1))
            found = [measure(texts[i:j]) for i, j in blocks([len(t) for t in texts])]
            if found:
                counts = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, counts)], [*kept, *COUNTS])

    return docs.select(*kept, F.col(text)).mapInArrow(run, schema)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """repetition() with base_failed and kept; all limits are compared in whole numbers."""
    counts = repetition(docs, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))
    bad = (100 * F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines")) | (100 * F.col("dup_line_chars") > LINE_CHAR_LIMIT * F.col("word_chars"))
    for n, most in GRAM_LIMITS.items():
        bad |= 100 * F.col(f"dup_chars_{n}") > most * F.col("word_chars")
    return counts.withColumns({"base_failed": failed, "kept": ~failed & ~bad})
