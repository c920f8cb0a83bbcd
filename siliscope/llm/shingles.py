"""Sets of word shingles, computed a batch of texts at a time without a Python object per word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes hashed at once; a longer text is cut at white space and its words are put together again
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = _U(0x2545F4914F6CDD1D)
# a random odd number per byte; A-Z share those of a-z
_BYTE = np.random.default_rng(5).integers(0, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (pow(_BASE, -1, 2 ** 64), _BASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of texts laid end to end, and how many words each text has.

    With sums of byte * base**-place a word's polynomial is a difference of two sums times base**start, modulo 2**64.
    """
    inside = ~_SPACE[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] |= inside[inner]
    stop[inner - 1] |= inside[inner - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    back, forth = _powers(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * back[:len(data)], out=sums[1:])
    return _mix((sums[last + 1] - sums[first]) * forth[first]), np.diff(np.searchsorted(first, cuts))


def _pieces(data: np.ndarray) -> list[np.ndarray]:
    """A long text cut at white space into pieces of about CHUNK bytes."""
    out, at = [], 0
    while len(data) - at > CHUNK:
        space = np.flatnonzero(_SPACE[data[at + CHUNK:]])
        stop = at + CHUNK + (int(space[0]) if len(space) else len(data))
        out.append(data[at:stop])
        at = min(stop, len(data))
    return [*out, data[at:]]


def _set_of(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, width)
    rolled = np.full(n - size + 1, _U(size))
    for k in range(size):
        rolled = rolled * _STEP + words[k:n - size + 1 + k]
    return np.unique(_mix(rolled))


def text_sets(column: pa.Array, width: int = 4) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of the distinct ``width``-word shingles of every text.

    ASCII letters are lower-cased; words are runs of anything but ASCII white space. A text of fewer words gives its whole
    sequence as one shingle, a text without words none.
    """
    column = column.cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, "right")) - 1)
        if cuts[j] - cuts[i] > CHUNK:  # one long text
            parts = _pieces(data[cuts[i]:cuts[j]])
            yield _set_of(np.concatenate([_word_hashes(p, np.array([0, len(p)]))[0] for p in parts]), width)
        else:
            hashes, counts = _word_hashes(data[cuts[i]:cuts[j]], cuts[i:j + 1] - cuts[i])
            ends = np.cumsum(counts)
            for lo, hi in zip((ends - counts).tolist(), ends.tolist()):
                yield _set_of(hashes[lo:hi], width)
        i = j
