"""Words of texts as hashes, in whole Arrow batches, and min-hash signatures over them.

"Words" are maximal runs of letters and digits, lower-cased. A null text has no words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
CACHE_WORDS = 1_000_000  # words kept by a worker; only saves time


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; frequent words come from a bounded cache."""
    get = _CACHE.get
    hashes = [get(w) for w in words]
    if None in hashes:
        if len(_CACHE) > CACHE_WORDS:
            _CACHE.clear()
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = _CACHE[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(hashes, dtype=np.uint64)


def word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of every text, one after another, and the number of them in each text."""
    sets = [set(WORD.findall(t.lower())) if t else set() for t in texts]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return hash_words([w for s in sets for w in s]), sizes


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, one a hash function."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhash(hashes: np.ndarray, sizes: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The hash of the least token under every function, a row a text; every text must have a token.

    A function permutes the hashes by an odd multiplication, so the token is recovered from its least value.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), len(functions)), np.uint64)
    for k, a in enumerate(functions):
        out[:, k] = np.minimum.reduceat(hashes * a, starts) * np.uint64(pow(int(a), -1, 1 << 64))
    return out


def distinct_words(text: Column) -> Column:
    """The distinct words of a text as an array, in the JVM."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: w != "")
