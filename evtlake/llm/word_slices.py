"""Texts of an Arrow batch as slices of words: positions, distinct words and who follows whom, on arrays of bytes.

A slice holds whole texts or parts of long ones, about STEP bytes together. A part is cut between
words and carries some words of the next part as context, so that every run of ``ahead + 1`` words
starts in exactly one part. A-Z are read in lower case.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STEP = 1 << 20


class Classes:
    """What a byte is: part of a word, between words, or a break that no run of words crosses."""

    def __init__(self, outside: bytes, breaks: bytes = b""):
        self.kind = np.zeros(256, np.uint8)
        self.kind[np.frombuffer(outside, np.uint8)] = 1
        self.kind[np.frombuffer(breaks, np.uint8)] = 2
        gap = b"[" + re.escape(outside + breaks) + b"]"
        word = b"[^" + re.escape(outside + breaks) + b"]"
        self.gap, self.next_word = re.compile(gap), re.compile(gap + b"*" + word + b"+")


@dataclass
class Slice:
    rows: np.ndarray  #: of every part, the row of the batch
    last: np.ndarray  #: of every part, whether it ends its text
    part: np.ndarray  #: of every word, its part
    owned: np.ndarray  #: of every word, whether it belongs to its part; others are context
    follows: np.ndarray  #: of every word, whether the next one is in the same part with no break between
    lengths: np.ndarray  #: of every word, its bytes
    letters: np.ndarray  #: bytes of all words, one after the other
    codes: np.ndarray  #: of every word, its place among the distinct ones
    words: pa.Array  #: distinct words

    def counts(self) -> np.ndarray:
        """Owned words of every part."""
        return np.bincount(self.part[self.owned], minlength=len(self.rows))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _parts(raw: bytes, classes: Classes, ahead: int, step: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text with their context, and where the context starts."""
    at = 0
    while len(raw) - at > 2 * step:
        found = classes.gap.search(raw, at + step)
        # what holds no further word stays with the last one
        if found is None or classes.next_word.match(raw, found.start()) is None:
            break
        cut = end = found.start()
        for _ in range(ahead):
            word = classes.next_word.match(raw, end)
            if word is None:
                break
            end = word.end()
        yield raw[at:end], cut - at
        at = cut
    yield raw[at:], len(raw) - at


def _slice(parts: list[tuple[int, bytes, int, bool]], classes: Classes) -> Slice:
    sizes = np.array([len(p[1]) + 1 for p in parts])
    firsts = np.cumsum(sizes) - sizes
    # texts are held apart by a line feed, which is inside no word
    data = _lower[np.frombuffer(b"\n".join(p[1] for p in parts), np.uint8)]
    kind = classes.kind[data]
    flags = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    part = np.searchsorted(firsts, starts, "right") - 1
    owned = starts < (firsts + np.array([p[2] for p in parts]))[part]
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (part[1:] == part[:-1]) & (breaks[1:] == breaks[:-1])
    letters, lengths = data[flags], ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return Slice(np.array([p[0] for p in parts]), np.array([p[3] for p in parts], bool), part, owned, follows, lengths, letters,
                 coded.indices.to_numpy(), coded.dictionary)


def slices(texts: Iterable[str | None], classes: Classes, ahead: int, step: int = STEP) -> Iterator[Slice]:
    """All texts in order, NULL as an empty one. Only the last part of a slice may be cut, and it goes on in the next one."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        parts = list(_parts(raw, classes, ahead, step))
        for i, (part, own) in enumerate(parts):
            held.append((row, part, own, i == len(parts) - 1))
            size += len(part)
            if size >= step:
                yield _slice(held, classes)
                held, size = [], 0
    if held:
        yield _slice(held, classes)
