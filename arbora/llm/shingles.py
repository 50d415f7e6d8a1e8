"""Sets of hashed word shingles of whole texts, computed with array operations over many texts at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and the number of words of each text.

    ``breaks`` tells for every byte whether it separates words.

    Bytes go eight at a time into 64-bit lanes: a word's hash mixes its lanes one after the other, so words of any
    length and content are told apart like by any 64-bit hash.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    low = _LOWER[raw]
    word = ~breaks[low]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[edges] = word[edges]
    start = np.flatnonzero(begin)
    end_mark = word.copy()
    end_mark[:-1] &= ~word[1:]
    end_mark[edges - 1] = word[edges - 1]
    length = np.flatnonzero(end_mark) + 1 - start
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    # lane[i] = bytes i .. i + 7
    lanes = np.lib.stride_tricks.as_strided(padded, (len(low) + 1, 8), (1, 1))
    h = mix(length.astype(np.uint64) * _ODD)
    masks = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    masks = np.concatenate([masks, [np.uint64(0xFFFFFFFFFFFFFFFF)]])
    left, at, rows = length.copy(), start.copy(), np.arange(len(start))
    while len(rows):
        lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel() & masks[np.minimum(left, 8)]
        h[rows] = mix(h[rows] * _ODD + lane)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    counts = np.diff(np.searchsorted(start, offsets))
    return h, counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one: the whole sequence. A text without words has none.
    """
    words, counts = word_hashes(raw, offsets)
    total = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= width:
        h = mix(words[: len(words) - width + 1] + _ODD)
        for k in range(1, width):
            h = mix(h * _ODD + words[k : len(words) - width + 1 + k])
    else:
        h = np.zeros(0, np.uint64)
    out = []
    for a, c in zip(total[:-1], counts):
        if c >= width:
            s = np.sort(h[a : a + c - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif c:
            short = mix(np.array([c], np.uint64))
            for w in words[a : a + c]:
                short = mix(short * _ODD + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
