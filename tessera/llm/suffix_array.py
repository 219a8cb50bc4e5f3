"""Suffix-array deduplication of bytes: every byte inside a string of `window` bytes that also starts elsewhere is removed.

See `repeats`: anchors' suffixes are sorted by Spark, and a stack scan over the common beginnings of
neighbours gives the interval tree, in which members with different left extensions are told apart, so
that each repeat is found with all its occurrences. `repeats` gives those groups; `deduplicated` needs of them only
how far each place's repeats reach, which the scan reduces before anything leaves the task.

Defined results: a null text counts as empty; texts shorter than the window lose nothing; rows that
repeat count as texts of their own, each the other's copy; a character cut in two leaves its other
bytes behind, as the rule works on bytes (`text` then shows a replacement sign, the digest does not).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, encoded, row_key
from tessera.llm.repeats import Symbols, merged, repeat_groups, repeated_spans, windows
from tessera.llm.sieve import joined as with_spans

WINDOW, RUN = 400, 64


def byte_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8).astype(U64) + U64(1), np.cumsum([len(t) for t in texts])


def keyed(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns to keep, the text (null as empty) and a key by which the row is found again."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("*", row_key("doc_id", "text").alias("key"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(repeat, length, doc_id, place): a row per occurrence of each maximal repeat of `window` bytes or more, `place`
    being its first byte. `repeat` is a hash of its bytes. What is longer than the surroundings of an anchor comes as
    overlapping stretches (see `repeat_groups`)."""
    rows = keyed(docs, doc_id, text)
    found = repeat_groups(rows.where(F.octet_length("text") >= window), Symbols(byte_values, 1, window, run, windows))
    return found.join(rows.select("key", "doc_id"), "key").select("repeat", "length", "doc_id", "place")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept_sha256): a row per document, text being what is left."""
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows.where(F.octet_length("text") >= window), Symbols(byte_values, 1, window, run, windows))
    joined = with_spans(rows, spans).select("doc_id", "text", "spans")
    schema = joined.select("doc_id", "text").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def cut(batches):
        for batch in batches:
            texts, out = encoded(batch.column(1)), [[] for _ in range(5)]
            for data, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                ranges, at, kept = merged(found), 0, []
                for a, b in ranges:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]]) if ranges else data
                for o, x in zip(out, (left.decode("utf-8", "replace"), len(data), len(data) - len(left), len(ranges), hashlib.sha256(left).hexdigest()), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)
