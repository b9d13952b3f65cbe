"""Words of UTF-8 texts as 64-bit hashes, found and hashed with numpy.

Words are runs of bytes other than white space of ASCII (09-0D and 20), so they are the
same runs of characters.  A hash is a polynomial in the word's bytes, each replaced by
a random 64-bit number, times powers of a fixed odd number modulo 2^64, then mixed; two
unlike words meet with a chance of about 2^-64, so among a thousand million distinct
words about one pair in forty such corpora is confused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are worked on at once; longer texts go on at a border between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = U(0xD1342543DE82EF95)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
LETTER = mix(np.arange(256, dtype=U))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; kept, as they are always the same."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a string column; null as empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = column.is_null().to_pylist() if column.null_count else None
    for k in range(len(column)):
        yield data[:0] if null and null[k] else data[offsets[k] : offsets[k + 1]]


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about PIECE bytes, cut only at white space."""
    while len(data) > PIECE:
        cut = PIECE
        while cut < len(data):
            found = np.flatnonzero(SPACE[data[cut : cut + PIECE]])
            if len(found):
                cut += int(found[0])
                break
            cut += PIECE
        yield data[:cut]
        data = data[cut:]
    yield data


def word_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    padded = np.ones(len(data) + 2, np.int8)
    padded[1:-1] = SPACE[data]
    turn = np.diff(padded)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end], which depends on the values and their order."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """One hash per word of a text, A-Z taken as a-z if ``lower``."""
    out = []
    for part in pieces(data):
        starts, ends = word_borders(part)
        out.append(range_hashes(LETTER[LOWER[part] if lower else part], starts, ends))
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; fewer words are one run; no words, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, U)
    for k in range(size):
        out = mix(out + words[k : len(words) - size + 1 + k])
    return out
