"""Distinct word shingles as sorted 64-bit hashes, from Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import chunks, mix, text_buffer, word_hashes

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = words[: n - k + 1] * _A + np.uint64(k)
    for j in range(1, k):
        out = mix(out * _B + words[j : n - k + 1 + j])
    return mix(out)


def distinct_shingles(col, k: int) -> Iterator[np.ndarray]:
    """For each row of a string column its sorted distinct shingle hashes."""
    data, offs = text_buffer(col)
    for lo, hi in chunks(offs):
        words, at = word_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        for i in range(hi - lo):
            yield np.unique(shingle_hashes(words[at[i] : at[i + 1]], k))
