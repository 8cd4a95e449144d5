"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and 0x09-0x0D.  Those bytes never occur inside
a multi-byte UTF-8 character, so words can be found without decoding.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go; a longer text is handled alone.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return None


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, and then what it has freed given back: its Python worker lives on
    beside the executor's next stages.  What refers to itself is freed by a collection only."""

    @functools.wraps(run)
    def done(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return done


def row_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive runs of about ``size`` bytes of text."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        done = upto[begin - 1] if begin else 0
        rows = max(1, int(np.searchsorted(upto, done + size, "right")) - begin)
        yield begin, rows
        begin += rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def geometric(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base, and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _powers[:n], _inverses[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of a rolling hash: ``span_hash`` reads any span's hash off them."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    powers, _ = geometric(len(symbols))
    np.cumsum(symbols * powers, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols in each [start, end); equal spans give equal hashes."""
    _, inverses = geometric(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


_BYTE_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64))
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


class Slice:
    """Some texts in one buffer, each followed by a line feed.

    ``first``/``last``: each text's first byte and the byte after its last one.
    ``word_start``/``word_end``: byte spans of all words; ``word_text``: the text each is in.
    ``word_from``: for text i the number of words before it, one more entry at the end.
    """

    def __init__(self, begin: int, texts: list[bytes]):
        self.begin = begin
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.last = np.cumsum(lengths + 1) - 1
        self.first = self.last - lengths
        inside = ~IS_SEPARATOR[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        self.word_start, self.word_end = edges[::2], edges[1::2]
        self.word_from = np.concatenate((np.searchsorted(self.word_start, self.first), [len(self.word_start)]))
        self.word_text = np.repeat(np.arange(len(texts)), np.diff(self.word_from))

    def __len__(self) -> int:
        return len(self.first)

    def prefix(self, lower: bool = False) -> np.ndarray:
        return prefix_hash(_BYTE_SYMBOLS[(_LOWER if lower else _AS_IS)[self.bytes]])

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return span_hash(self.prefix(lower), self.word_start, self.word_end)


def slices(texts) -> Iterator[Slice]:
    """The texts (None: empty) in consecutive slices of about ``SLICE_BYTES``."""
    begin, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        if held and size + len(data) > SLICE_BYTES:
            yield Slice(begin, held)
            begin, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield Slice(begin, held)


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of n words that lies in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - n + 1
    rolled = np.full(count, n, np.uint64)
    for j in range(n):
        rolled = rolled * _BASE + hashes[j : j + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mix64(rolled[at]), at
