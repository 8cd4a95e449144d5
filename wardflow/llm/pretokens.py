"""The pieces that a byte-level tokenizer's pattern cuts texts into, found with numpy.

Implements the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

over many texts at once: characters are looked up in a table of four classes, runs of one class
are pieces, and the pattern's special cases move a few boundaries.  Equal pieces of a slice are
then found by a hash of their characters, so that each distinct piece is encoded once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from wardflow.llm.words import mix64, prefix_hash, span_hash

#: Characters handled in one go; a longer text is handled alone.
SLICE_CHARS = 1 << 19
#: Distinct pieces a worker remembers at most: it forgets the half not seen for longest.  About 80 bytes each.
REMEMBERED = 1_000_000

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The characters of \s.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    # letters and numbers are word characters: few of all code points are asked for their category
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for found in re.finditer(r"\w+", every):
        table[slice(*found.span())] = [kinds.get(unicodedata.category(c)[0], OTHER) for c in found[0]]
    table[WHITE_SPACE] = SPACE
    return table


@functools.cache
def _symbols() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; ``first``: where texts start (none empty)."""
    kind = _classes()[codes]
    n = len(codes)
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    start = opens.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # white space before something else of the same text: its last character stands alone,
    # and if that is a space it belongs to what follows
    at = np.flatnonzero(start[:n] & ~opens[:n])
    after_space = at[kind[at - 1] == SPACE]
    start[after_space - 1] = True
    joined = after_space[codes[after_space - 1] == 32]
    start[joined] = False
    # an apostrophe alone, no space joined to it, then a letter
    quote = np.flatnonzero((codes == 39) & start[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[start[quote + 1] & ~opens[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
        done = np.zeros(len(quote), bool)
        for tail in CONTRACTIONS:
            fits = ~done
            for j, c in enumerate(tail, 1):
                fits &= padded[quote + j] == ord(c)
                if j > 1:
                    fits &= ~opens[np.minimum(quote + j, n)]
            done |= fits
            ends = quote[fits] + 1 + len(tail)
            start[quote[fits] + 1] = False
            start[ends[ends < n]] = True
    return start[:n]


class Pieces:
    """The pieces of some texts: ``distinct`` strings, and ``which`` of them stands at each place.

    Text i of the slice has the pieces ``text_from[i]`` to ``text_from[i + 1]``.  Distinct piece k is of
    hash ``hashes[k]`` (ascending) and lies at ``starts[k]`` to ``stops[k]`` of the code points ``codes``.
    """

    def __init__(self, begin: int, texts: list[str]):
        self.begin, self.count = begin, len(texts)
        self.whole = whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        first = ends - lengths
        if not whole:
            self.codes, self.hashes = np.zeros(0, np.uint32), np.zeros(0, np.uint64)
            self.starts = self.stops = self.which = np.zeros(0, np.int64)
            self.text_from = np.zeros(len(texts) + 1, np.int64)
            return
        self.codes = codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(piece_starts(codes, first[lengths > 0]))
        stops = np.append(starts[1:], len(codes))
        hashes = span_hash(prefix_hash(_symbols()[codes]), starts, stops)
        order = np.argsort(hashes)
        ascending = hashes[order]
        new = np.append(True, ascending[1:] != ascending[:-1])
        self.hashes, at = ascending[new], order[new]
        self.starts, self.stops = starts[at], stops[at]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.text_from = np.searchsorted(starts, np.append(first, len(codes)))

    def __len__(self) -> int:
        return self.count

    def strings(self, some: np.ndarray) -> list[str]:
        """The distinct pieces of these numbers."""
        whole = self.whole
        return [whole[a:b] for a, b in zip(self.starts[some].tolist(), self.stops[some].tolist(), strict=True)]

    @property
    def distinct(self) -> list[str]:
        return self.strings(np.arange(len(self.hashes)))


def pieces(texts) -> Iterator[Pieces]:
    """The texts (None: empty) in consecutive slices of about ``SLICE_CHARS``."""
    begin, size, held = 0, 0, []
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > SLICE_CHARS:
            yield Pieces(begin, held)
            begin, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield Pieces(begin, held)


def runs(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin there and are so long, one after another."""
    upto = np.cumsum(lengths)
    return values[np.repeat(begins - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]


def spread(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[w]:offsets[w + 1]]`` for all w in ``which``, one after another,
    and where each begins (with the end last)."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    return runs(values, offsets[which], lengths), np.concatenate(([0], np.cumsum(lengths)))


class _Runs:
    """Runs of 32-bit numbers, one after another in one array that grows at its end."""

    def __init__(self):
        self.held, self.upto = np.empty(1 << 10, np.uint32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.upto[-1])
        end = used + len(values)
        if end > len(self.held):
            grown = np.empty(end + end // 2, np.uint32)
            grown[:used] = self.held[:used]
            self.held = grown
        self.held[used:end] = values
        self.upto = np.concatenate((self.upto, used + np.cumsum(lengths)))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places, one after another, and their lengths."""
        begins = self.upto[places]
        lengths = self.upto[places + 1] - begins
        return runs(self.held, begins, lengths), lengths


class _Remembered:
    """Pieces and their ids in a few arrays, found by the piece's hash and its characters."""

    def __init__(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.characters, self.ids = _Runs(), _Runs()

    def __len__(self) -> int:
        return len(self.places)

    def places_of(self, part: Pieces, some: np.ndarray) -> np.ndarray:
        """Where these distinct pieces lie; -1: not here."""
        found = np.full(len(some), -1, np.int64)
        if not len(self):
            return found
        hashes = part.hashes[some]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        places = self.places[at[hit]].astype(np.int64)
        begins = part.starts[some[hit]]
        lengths = part.stops[some[hit]] - begins
        same = np.diff(self.characters.upto)[places] == lengths
        hit, places, begins, lengths = hit[same], places[same], begins[same], lengths[same]
        unlike = np.flatnonzero(self.characters.of(places)[0] != runs(part.codes, begins, lengths))
        found[hit] = places
        # another piece of the same hash
        found[hit[np.searchsorted(np.cumsum(lengths), unlike, "right")]] = -1
        return found

    def add(self, part: Pieces, some: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Remember the ids of these distinct pieces; returns their places."""
        places = np.arange(len(self), len(self) + len(some))
        begins = part.starts[some]
        sizes = part.stops[some] - begins
        self.characters.add(runs(part.codes, begins, sizes), sizes)
        self.ids.add(ids, lengths)
        # of pieces of one hash the first is found again
        at = np.searchsorted(self.hashes, part.hashes[some], "right")
        self.hashes = np.insert(self.hashes, at, part.hashes[some])
        self.places = np.insert(self.places, at, places)
        return places


class RememberingEncoder:
    """Ids of whole texts, encoding each distinct piece once.

    ``encode`` turns a list of pieces into a list of packed ids (little-endian unsigned 32 bits).
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.encode, self.half = encode, remembered // 2
        self.recent, self.older = _Remembered(), _Remembered()

    def _places(self, part: Pieces) -> np.ndarray:
        """Where each distinct piece of the slice lies among the recent ones."""
        recent = self.recent
        places = recent.places_of(part, np.arange(len(part.hashes)))
        missing = np.flatnonzero(places < 0)
        at = self.older.places_of(part, missing)
        known = missing[at >= 0]
        places[known] = recent.add(part, known, *self.older.ids.of(at[at >= 0]))
        new = missing[at < 0]
        packed = self.encode(part.strings(new))
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        places[new] = recent.add(part, new, np.frombuffer(b"".join(packed), "<u4"), lengths)
        return places

    def __call__(self, texts) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each slice: the number of its first text, and the ids of each of its texts."""
        for part in pieces(texts):
            if not len(part.hashes):
                yield part.begin, [np.zeros(0, np.uint32)] * len(part)
                continue
            ids, lengths = self.recent.ids.of(self._places(part))
            begins = np.concatenate(([0], np.cumsum(lengths)))
            if len(self.recent) > self.half:
                self.older, self.recent = self.recent, _Remembered()
            ids, begins = spread(ids, begins, part.which)
            cuts = begins[part.text_from].tolist()
            yield part.begin, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
