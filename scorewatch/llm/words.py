"""Words of whole texts as integer codes: one C++ pass splits and dictionary-encodes a
slice of texts, so Python touches each distinct word of a slice once. No texts, and null, empty or
blank ones, have no words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def strings(values: pa.Array) -> list[str]:
    """Python strings of an array without nulls."""
    return values.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(counts, codes, dictionary) of the words `[^\\x20\\x09-\\x0D]+` of each text (null: none).
    `counts[i]` words of text i follow each other in `codes`, which index `dictionary`."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    counts = np.bincount(owner[real], minlength=len(texts)).astype(np.int64)
    enc = flat.filter(pa.array(real)).dictionary_encode()
    return counts, enc.indices.to_numpy().astype(np.int64), enc.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings(dictionary)), np.uint64, len(dictionary))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): for flat elements dealt by `counts`, the row and the place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - starts[owner]


def window_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n consecutive elements inside a row, and their rows."""
    owner, place = positions(counts)
    ok = place + n <= counts[owner]
    idx = np.flatnonzero(ok)
    h = np.zeros(len(idx), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[idx + k])
    return h, owner[idx]
