"""Rabin-Karp hashes of word windows, over whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the two polynomials, and the steps of the final mix.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made longer as needed."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, 1 << 64))
        self.tables = tuple(np.ones(1, np.uint64) for _ in self.steps)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            self.tables = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, s, np.uint64)])) for s in self.steps
            )
        return self.tables


_BYTE_POWERS, _WORD_POWERS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(values: np.ndarray) -> np.ndarray:
    for shift, step in zip((30, 27), MIX, strict=True):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(step)
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every white-space separated word of all texts, and each text's first word; one more entry ends the last."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = np.concatenate([[True], _SPACE[buffer], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    power, inverse = _BYTE_POWERS.upto(len(buffer))
    terms = (buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)]
    sums = np.add.reduceat(terms, edges if edges[-1] < len(buffer) else edges[:-1])[::2]
    hashes = mix(sums * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(MIX[1]))
    return hashes, np.concatenate([[0], np.searchsorted(starts, stops)])


def window_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each window among all words, first word of each text) of every window within a text."""
    words, firsts = word_hashes(texts)
    power, inverse = _WORD_POWERS.upto(len(words) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])])
    counts = np.diff(firsts)
    fits = np.maximum(counts - size + 1, 0)
    at = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(fits)[:-1]]), fits) + np.arange(fits.sum())
    return mix((prefix[at + size] - prefix[at]) * inverse[at]), at, firsts


def covered(count: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of count words lie in a window that starts at one of the positions: the union of the intervals."""
    change = np.zeros(count + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def chunks(texts: Iterator[bytes], limit: int) -> Iterator[list[bytes]]:
    """Runs of texts of about limit bytes together; a longer text stands alone and whole."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text) + 1
    if run:
        yield run


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane: the shuffle's compression then removes the high ones."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
