"""Plain computations that the operators' results are held against."""

import collections
import hashlib
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed, n=80, vocabulary=30):
    """Random texts with shared passages, copies, nulls, empty ones and runs of one word."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["é", "日本", "zz"]
    texts = []
    for _ in range(n):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        if texts and rng.random() < 0.5:
            other = words(rng.choice(texts))
            at = rng.randint(0, len(other))
            t = t[:20] + other[at : at + rng.randint(5, 60)] + t[20:]
        if rng.random() < 0.1:
            t = ["aa"] * rng.randint(0, 90)
        texts.append(None if rng.random() < 0.05 else rng.choice([" ", "\n", "\t "]).join(t))
    return texts + texts[:4] + ["", None]


def covered(sequences, window):
    """For each sequence, the positions inside a window that starts elsewhere too."""
    seen = collections.Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        inside = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                inside[i : i + window] = [True] * window
        out.append(inside)
    return out


def removal(sequences, window, join):
    rows = []
    for s, inside in zip(sequences, covered(sequences, window)):
        kept = [x for x, c in zip(s, inside) if not c]
        runs = sum(c and not (i and inside[i - 1]) for i, c in enumerate(inside))
        rows.append((len(s), sum(inside), runs, hashlib.sha256(join(kept)).hexdigest()))
    return rows


def fingerprint(text, width, seed=42):
    import xxhash

    w = words(lower(text))
    runs = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fingerprints, ids, distance):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fingerprints[i] ^ fingerprints[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def edit_search(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def cosine(a, b):
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
