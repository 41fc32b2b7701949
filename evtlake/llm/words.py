"""Words of a text as 64-bit hashes, computed on arrays of bytes.

A word is a run of digits, ASCII letters (read in lower case) and bytes of other alphabets.
Hashes are polynomial in the bytes of a word over random 64-bit values and then mixed, so
equal words have equal hashes everywhere.
"""

import re

import numpy as np

STEP = 1 << 20
_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, dtype=bool)
_is_word[48:58] = _is_word[97:123] = _is_word[128:] = _is_word[65:91] = True
_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_lower]
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _P)])) if n else np.empty(0, np.uint64)


_powers = powers(64)


def _part(data: np.ndarray) -> np.ndarray:
    flags = _is_word[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    table = _powers if longest <= len(_powers) else powers(longest)
    values = _values[data[flags]]
    firsts = np.cumsum(lengths) - lengths
    values *= table[np.arange(len(values)) - np.repeat(firsts, lengths)]
    return mix(np.add.reduceat(values, firsts))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of all words in order. Long texts are read a megabyte at a time, cut between words."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode()
    if len(raw) <= STEP:
        return _part(np.frombuffer(raw, np.uint8))
    parts, at = [], 0
    while at < len(raw):
        m = _OTHER.search(raw, min(at + STEP, len(raw)))
        to = m.end() if m else len(raw)
        parts.append(_part(np.frombuffer(raw, np.uint8, to - at, at)))
        at = to
    return np.concatenate(parts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _P
        out += words[j:j + n]
    return mix(out)
