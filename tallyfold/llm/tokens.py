"""Vectorised hashing of words and word shingles, over whole Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F],
                 dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, dtype=np.uint64)]))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at blanks and 0x09-0x0D), first word of each text, and the
    bytes each word spans."""
    raw, offsets = utf8(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    letters = raw[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint64)
    sizes = ends - starts
    at = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=at[1:])
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    with np.errstate(over="ignore"):
        letters += np.uint64(1)
        letters *= powers(int(sizes.max()))[place]
        hashes = np.add.reduceat(letters, at) + sizes.astype(np.uint64) * MULT
    return mixed(hashes), first, starts, ends


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; runs over the ends of texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = (total * MULT) + (hashes[j:j + n] ^ SEEDS[j % 5]) * SEEDS[(j + 1) % 5]
        return mixed(total + np.uint64(k))


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; fewer words are one shingle."""
    hashes, first, _, _ = words(texts)
    runs = windows(hashes, k)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            own = np.sort(runs[a:b - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield windows(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
