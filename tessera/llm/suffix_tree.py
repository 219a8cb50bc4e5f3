"""Suffix-tree deduplication of words: every word inside a run of `window` words that also starts elsewhere is removed.

See `repeats`: suffixes are partitioned by a prefix, the anchor's run of words, and a partition that
would not fit a task is split by prefixes that grow until its parts do, up to the whole window; in each one the
nodes of its suffix tree that are deep enough, with what their members share to the left, give the repeats.

Words are runs of bytes that are not ASCII white space, unchanged. Defined results: a null text has no
words; texts of fewer words than the window lose nothing; rows that repeat count as texts of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, Rolling, encoded, word_bounds
from tessera.llm.repeats import Symbols, by_prefixes, merged, repeated_spans
from tessera.llm.sieve import joined as with_spans
from tessera.llm.suffix_array import keyed

WINDOW, RUN = 35, 8


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, and the number of words up to each text's end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    start, end = word_bounds(data)
    return Rolling(BYTE_VALUE[data]).ranges(start, end), np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns of `keep`, text, n_words, n_removed, kept_sha256): a row per document.

    text is the input where nothing was removed; else its removed words are gone, with the white space after each."""
    rows = keyed(docs, doc_id, text, keep)
    spans = repeated_spans(rows.where(F.octet_length("text") >= 2 * window - 1), Symbols(word_values, 6, window, run, by_prefixes))
    joined = with_spans(rows, spans).select("doc_id", *keep, "text", "spans")
    schema = joined.select("doc_id", *keep, "text").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def cut(batches):
        for batch in batches:
            texts, out = encoded(batch.column(batch.num_columns - 2)), [[] for _ in range(4)]
            for data, found in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words, ranges = data.split(), merged(found)
                kept, at = [], 0
                for a, b in ranges:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left = data
                if ranges:
                    start, _ = word_bounds(np.frombuffer(data, dtype=np.uint8))
                    parts, at = [], 0
                    for a, b in ranges:
                        parts.append(data[at : start[a]])
                        at = start[b] if b < len(start) else len(data)
                    left = b"".join([*parts, data[at:]])
                for o, x in zip(out, (left.decode(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:3]), pa.array(out[3], pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)
