"""Chunk filters as Arrow batches of bytes: what one task does to the payloads that Spark deals it."""

from __future__ import annotations

import zlib

import numpy as np
import zstandard

from tessera.errors import ChecksumMismatch, Malformed, Unsupported

# Registered filter numbers.
DEFLATE, SHUFFLE, FLETCHER32, ZSTD = 1, 2, 3, 32015
SUPPORTED = frozenset({DEFLATE, SHUFFLE, FLETCHER32, ZSTD})


def shuffled(data: bytes, size: int) -> bytes:
    """Bytes grouped by their place in an element; a remainder stays behind as it is."""
    whole = len(data) // size * size
    return np.frombuffer(data, np.uint8, whole).reshape(-1, size).T.tobytes() + data[whole:] if size > 1 else data


def unshuffled(data: bytes, size: int) -> bytes:
    whole = len(data) // size * size
    return np.frombuffer(data, np.uint8, whole).reshape(size, -1).T.tobytes() + data[whole:] if size > 1 else data


def bitshuffled(data: bytes, size: int) -> bytes:
    """Bits grouped by their place in an element, for whole groups of eight elements; the rest stays."""
    whole = len(data) // (8 * size) * 8 * size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, whole).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[whole:]


def unbitshuffled(data: bytes, size: int) -> bytes:
    whole = len(data) // (8 * size) * 8 * size
    if not whole:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, whole).reshape(8 * size, -1), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[whole:]


def fletcher32(data: bytes) -> int:
    """Two sums modulo 65535 over big-endian 16-bit words; a last odd byte is a word's high byte."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    n = len(words)
    first = int(words.sum()) if n else 0
    second = int((words * np.arange(n, 0, -1, dtype=np.uint64) % np.uint64(65535)).sum()) if n else 0
    # in this arithmetic a sum that is a multiple of 65535 stays 65535, unless nothing was added
    fold = lambda x: x % 65535 or (65535 if x else 0)
    return fold(second) << 16 | fold(first)


def encode(data: bytes, filters: list[int], size: int) -> bytes:
    for f in filters:
        if f == DEFLATE:
            data = zlib.compress(data, 6)
        elif f == SHUFFLE:
            data = shuffled(data, size)
        elif f == FLETCHER32:
            data += fletcher32(data).to_bytes(4, "little")
        elif f == ZSTD:
            data = zstandard.ZstdCompressor().compress(data)
        else:
            raise Unsupported(f"filter {f}")
    return data


def decode(data: bytes, filters: list[int], size: int, length: int, mask: int = 0) -> bytes:
    """Undo the filters in reverse; bit i of the mask says that filter i was left out. More than `length` bytes, with a sum, are malformed, and not made."""
    for i in reversed(range(len(filters))):
        f = filters[i]
        if mask >> i & 1:
            continue
        if f == DEFLATE:
            try:
                undone = zlib.decompressobj()
                data = undone.decompress(data, length + 5)
                if len(data) > length + 4:
                    raise Malformed(f"deflate: more than {length} bytes")
            except zlib.error as e:
                raise Malformed(f"deflate: {e}") from e
        elif f == SHUFFLE:
            data = unshuffled(data, size)
        elif f == FLETCHER32:
            data, tail = data[:-4], data[-4:]
            have = fletcher32(data)
            swapped = (have & 0x00FF00FF) << 8 | have >> 8 & 0x00FF00FF  # written by a machine of the other byte order
            if int.from_bytes(tail, "little") not in (have, swapped):
                raise ChecksumMismatch("fletcher32: sums differ")
        elif f == ZSTD:
            try:
                with zstandard.ZstdDecompressor().stream_reader(data, closefd=False) as reader:
                    data = reader.read(length + 5)
                if len(data) > length + 4:
                    raise Malformed(f"zstd: more than {length} bytes")
            except zstandard.ZstdError as e:
                raise Malformed(f"zstd: {e}") from e
        else:
            raise Unsupported(f"filter {f}")
    return data


def rotated(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint32(k) | x >> np.uint32(32 - k)


def lookup3(values: list[bytes]) -> np.ndarray:
    """Jenkins' hash of each value, for all values at once: one round of 12 bytes a step."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    rounds = np.maximum(-(-sizes // 12), 1)
    most = int(rounds.max(initial=1))
    matrix = np.zeros((len(values), 12 * most), np.uint8)
    for i, v in enumerate(values):
        matrix[i, : len(v)] = np.frombuffer(v, np.uint8)
    words = matrix.view("<u4").astype(np.uint32).reshape(len(values), most, 3)
    start = np.uint32(0xDEADBEEF) + sizes.astype(np.uint32)
    a, b, c = start.copy(), start.copy(), start.copy()
    for r in range(most):
        on, last = rounds > r + 1, (rounds == r + 1) & (sizes > 0)
        x, y, z = a + words[:, r, 0], b + words[:, r, 1], c + words[:, r, 2]
        p, q, s = x, y, z
        for k, (u, v, w) in zip((4, 6, 8, 16, 19, 4), [("p", "s", "q"), ("q", "p", "s"), ("s", "q", "p")] * 2, strict=True):
            at = {"p": p, "q": q, "s": s}
            at[u] = (at[u] - at[v]) ^ rotated(at[v], k)
            at[v] = at[v] + at[w]
            p, q, s = at["p"], at["q"], at["s"]
        for u, v, k in (("z", "y", 14), ("x", "z", 11), ("y", "x", 25), ("z", "y", 16), ("x", "z", 4), ("y", "x", 14), ("z", "y", 24)):
            at = {"x": x, "y": y, "z": z}
            at[u] = (at[u] ^ at[v]) - rotated(at[v], k)
            x, y, z = at["x"], at["y"], at["z"]
        a, b, c = (np.where(on, m, np.where(last, f, o)) for m, f, o in ((p, x, a), (q, y, b), (s, z, c)))
    return c
