"""Word shingles of many texts at once, in numpy.

The texts of a batch are one byte array. Words are runs of bytes other than ASCII white space, after
lower-casing A-Z; a word's hash is read off prefix sums of ``byte * r**position`` modulo 2**64, and a
shingle's hash mixes the hashes of its words, so no word is ever a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Texts are hashed in slices of about so many bytes, to bound memory.
SLICE_BYTES = 1 << 19

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of r and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * SLICE_BYTES)
            steps = np.full(size, _R, np.uint64)
            back = np.full(size, _R_INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def slices(values: pa.Array) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as bytes, about ``SLICE_BYTES`` at a time; NULL reads as empty."""
    values = values.cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, length in enumerate(lengths.tolist(), 1):
        size += length + 1
        if size >= SLICE_BYTES or i == len(lengths):
            yield [v or b"" for v in values.slice(start, i - start).to_pylist()]
            start, size = i, 0


def shingle_sets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, sorted, one after the other; and their offsets.

    A text with fewer than ``WORDS`` words has its word sequence as one shingle, a text without
    words none.
    """
    joined = b"\n".join(values).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, len(values)))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    first = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    up, down = _POWERS.of(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up)))
    words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    per_text = np.diff(np.searchsorted(first, ends), prepend=0)
    starts = np.cumsum(per_text) - per_text

    window = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        window += words[k:k + len(window)] * _PLACE[k]
    window = mix(window)
    sets: list[np.ndarray] = []
    for start, n in zip(starts.tolist(), per_text.tolist(), strict=True):
        if n >= WORDS:
            found = np.sort(window[start:start + n - WORDS + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif n:
            found = mix(np.sum(words[start:start + n] * _PLACE[:n], keepdims=True)
                        + np.uint64(n))
        else:
            found = np.empty(0, np.uint64)
        sets.append(found)
    offsets = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offsets
