"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding.  A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours
are: the encoding of their joined bytes is these two tokens.  So each prefix of a text has one last
token, found from the tokens that end there and the last token of what lies before them.  The
transducer reads byte by byte.  A state holds the token that was emitted last and the bytes since
then, with the last token of each of their prefixes.  A token is emitted as soon as every
way the text can go on agrees on it: that is when all places from which a longer token could still
start have it on their path, which the length of the longest token bounds.  States and
transitions are made when a text first needs them, and remembered; so are whole pieces.

Decoding.  Ids become bytes by a table; ``Utf8Stream`` holds back a character's bytes until it
is complete, so that every chunk can be shown as it comes.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.pretokens import RememberingEncoder, spread
from wardflow.llm.words import SLICE_BYTES, releasing, row_slices

#: Remembered states, after which a worker starts again with none, and remembered pieces and pairs.
STATES, PIECES, PAIRS = 200_000, 250_000, 100_000


class Merges:
    """A rank file: the bytes of each id, and which two ids merge into which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        # one object for each id and its packed form, however often they are remembered
        self.numbers = list(range(len(self.bytes)))
        self.packed = [struct.pack("<I", i) for i in self.numbers]
        self.sizes = list(map(len, self.bytes))
        # of the tokens and all their beginnings: twice the rank (-2: no token), one more if a token goes on from there
        self.known = dict.fromkeys((token[:i] for token in ranks for i in range(len(token))), -1)
        for token, rank in ranks.items():
            self.known[token] = 2 * rank + (token in self.known)
        self.pair_of = functools.lru_cache(PAIRS)(self._split)
        self.neighbours = functools.lru_cache(PAIRS)(self._neighbours)

    def forget(self) -> None:
        self.pair_of.cache_clear()
        self.neighbours.cache_clear()

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is this one; a token that no merge makes is its own pair."""
        ids = [self.ranks[bytes([b])] for b in self.bytes[token]]
        while len(ids) > 2:
            ranked = [(self.merged(a, b), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            best, at = min(((r, i) for r, i in ranked if r is not None), default=(None, 0))
            if best is None:
                return token, token
            ids[at : at + 2] = [best]
        return (ids[0], ids[1]) if len(ids) == 2 else (token, token)

    def merged(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.bytes[a] + self.bytes[b])

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joined bytes is a, b.

        Undo the merges that made a and b, latest first: none that would have joined what
        lies on both sides of the boundary may come earlier than the one that was undone.
        """
        limit = 1 << 62
        while True:
            joined = self.merged(a, b)
            if joined is not None and joined < limit:
                return False
            left, right = self.pair_of(a), self.pair_of(b)
            can_left, can_right = left != (a, a), right != (b, b)
            if not can_left and not can_right:
                return True
            if can_left and (a > b or not can_right):
                # a merge at the boundary of the same rank comes after one to the left of it
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]


#: Where no further moves are remembered.
_NO_MOVES: dict = {}


class _State:
    """What the bytes read so far leave open.

    ``key``: the pending bytes, then the token that ends at each place in them, at place 0 the one emitted
    last; None where no way on needs it.  ``live``: the places from which a longer token may start.
    Half of all states are left by one byte only: the first move, by ``byte``, needs no dict.
    """

    __slots__ = ("key", "live", "byte", "move", "next", "rest")

    def __init__(self, key: tuple, live: tuple):
        self.key, self.live = key, live
        self.byte: int | None = None
        self.move: tuple[_State, bytes] | None = None
        self.next: dict[int, tuple[_State, bytes]] = _NO_MOVES
        self.rest: bytes | None = None


_ONE = [bytes((b,)) for b in range(256)]


class Transducer:
    """``encode`` gives a piece's packed ids; ``read`` and ``finish`` work on a byte stream."""

    def __init__(self, merges: Merges, most_states: int = STATES):
        self.merges, self.most_states = merges, most_states
        self.clear()

    def clear(self) -> None:
        # states lead to one another in circles: cut these, so that they go without the garbage collector
        for state in (self.start, *self.states.values()) if hasattr(self, "states") else ():
            state.move, state.next = None, _NO_MOVES
        self.states: dict[tuple, _State] = {}
        self.places: dict[tuple, tuple] = {}
        self.start = _State((b"", None), (0,))

    def _packed(self, key: tuple, end: int) -> bytes:
        """The packed tokens up to place ``end``."""
        path, sizes, packed = [], self.merges.sizes, self.merges.packed
        while end > 0:
            token = key[end + 1]
            path.append(packed[token])
            end -= sizes[token]
        return path[0] if len(path) == 1 else b"".join(path[::-1])

    def _step(self, state: _State, byte: int) -> tuple[_State, bytes]:
        merges, before = self.merges, state.key
        pending, known, sizes = before[0] + _ONE[byte], merges.known, merges.sizes
        n, token, live = len(pending), None, []
        # bit i stands for place i: those from which a longer token may start
        ends = 1 << n
        for at in state.live:
            code = known.get(pending[at:])
            if code is None:
                continue
            if token is None and code >= 0:
                rank, upto = merges.numbers[code >> 1], before[at + 1]
                if upto is None or merges.neighbours(upto, rank):
                    token = rank
            if code & 1:
                live.append(at)
                ends |= 1 << at
        now = (*before, token)
        live.append(n)
        # where the ways back from all live places meet
        needed = ends
        while ends & (ends - 1):
            far = ends.bit_length() - 1
            near = 1 << (far - sizes[now[far + 1]])
            ends = ends ^ (1 << far) | near
            needed |= near
        meet = ends.bit_length() - 1
        out = self._packed(now, meet) if meet else b""
        if meet == n:
            key = (b"", token)
        else:
            kept = [now[at + 1] if needed >> at & 1 else None for at in range(meet, n + 1)]
            if live[0] != meet:
                kept[0] = None
            key = (pending[meet:], *kept)
        after = self.states.get(key)
        if after is None:
            places = tuple([at - meet for at in live])
            after = self.states[key] = _State(key, self.places.setdefault(places, places))
        return after, out

    def read(self, state: _State, byte: int) -> tuple[_State, bytes]:
        """The state after one more byte, and the packed ids that became certain with it."""
        if state.byte == byte:
            return state.move
        move = state.next.get(byte)
        if move is None:
            move = self._step(state, byte)
            if state.byte is None:
                state.byte, state.move = byte, move
            elif state.next is _NO_MOVES:
                state.next = {byte: move}
            else:
                state.next[byte] = move
        return move

    def finish(self, state: _State) -> bytes:
        """The ids that are left when the text ends in this state."""
        if state.rest is None:
            state.rest = self._packed(state.key, len(state.key[0]))
        return state.rest

    def encode(self, piece: bytes) -> bytes:
        if len(self.states) > self.most_states:
            self.clear()
        state, out = self.start, b""
        for byte in piece:
            if state.byte == byte:
                state, certain = state.move
            else:
                try:
                    state, certain = state.next[byte]
                except KeyError:
                    state, certain = self.read(state, byte)
            if certain:
                out += certain
        return out + self.finish(state)


@functools.cache
def _merges(ranks_path: str) -> Merges:
    return Merges.from_file(ranks_path)


def new_encoder(ranks_path: str, pieces: int = PIECES, states: int = STATES) -> RememberingEncoder:
    transducer = Transducer(_merges(ranks_path), states)

    def run(found: list[str]) -> list[bytes]:
        # all that is made here is kept: the garbage collector would walk over it again and again
        collecting = gc.isenabled()
        gc.disable()
        try:
            return [transducer.encode(p.encode("utf-8", "replace")) for p in found]
        finally:
            if collecting:
                gc.enable()

    return RememberingEncoder(run, pieces)


@functools.cache
def encoder(ranks_path: str) -> RememberingEncoder:
    """Kept for the life of a process; tasks take ``in_task``."""
    return new_encoder(ranks_path)


def slices_encoded(
    batches: Iterator[pa.RecordBatch], place: int, encode: RememberingEncoder
) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """The rows of a slice, their texts (of column number ``place``; null: empty) and the ids of each.

    Batches go through as they come; only the texts of one slice of rows are Python strings at a time.
    """
    for batch in batches:
        for begin, n in row_slices(batch.column(place).cast(pa.string()), SLICE_BYTES):
            part = batch.slice(begin, n)
            texts = [t if isinstance(t, str) else "" for t in part.column(place).to_pylist()]
            yield part, texts, [x for _, some in encode(texts) for x in some]


def in_task(
    run: Callable[[RememberingEncoder, Iterator], Iterator], ranks_path: str, states: int = STATES
) -> Callable[[Iterator], Iterator]:
    """``run`` over batches with an encoder that ends with its task, as does the rank file: the
    Python worker goes on beside other stages, and beside the next run's."""

    def done(batches: Iterator) -> Iterator:
        yield from run(new_encoder(ranks_path, PIECES, states), batches)
        _merges.cache_clear()
        decoder.cache_clear()

    return releasing(done)


#: Continuation bytes still to come after each lead byte, by the byte's high bits.
def _following(byte: int) -> int:
    return 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0


class Utf8Stream:
    """An incremental UTF-8 machine: its state is the bytes of a character not yet complete."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> bytes:
        """What is complete now; the start of a character at the end waits for the next chunk."""
        data = self.held + chunk
        back = 1
        while back <= min(3, len(data)) and 0x80 <= data[-back] < 0xC0:
            back += 1
        cut = len(data)
        if back <= min(3, len(data)) and _following(data[-back]) >= back:
            cut -= back
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class Decoder:
    """Bytes of ids in chunks that end between characters."""

    def __init__(self, merges: Merges, chunk: int = 1 << 16):
        self.values = np.frombuffer(b"".join(merges.bytes), np.uint8)
        self.offsets = np.cumsum([0, *map(len, merges.bytes)])
        self.chunk = chunk

    def __call__(self, ids: np.ndarray) -> Iterator[bytes]:
        stream = Utf8Stream()
        for at in range(0, len(ids), self.chunk):
            yield stream.feed(spread(self.values, self.offsets, ids[at : at + self.chunk])[0].tobytes())
        yield stream.finish()


@functools.cache
def decoder(ranks_path: str) -> Decoder:
    return Decoder(_merges(ranks_path))


def encode_column(
    documents: DataFrame, ranks_path: str, column: str = "text", to: str = "ids", check: str | None = None
) -> DataFrame:
    """``documents`` with a binary column: the text's ids as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids.  ``check`` names a column for whether the ids decode to the
    text again.  All other columns stay; those of the added names are replaced.  Rows that repeat are
    encoded each on its own, and an empty table stays empty.  What a task remembers ends with it.
    """
    rows = documents.drop(to, *[check] * bool(check))
    wide = rows.withColumn(to, F.lit(b""))
    schema = (wide.withColumn(check, F.lit(True)) if check else wide).schema
    place, names = rows.columns.index(column), schema.names

    def run(encode: RememberingEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in slices_encoded(batches, place, encode):
            more = [pa.array([x.tobytes() for x in found], pa.binary())]
            if check:
                decode = decoder(ranks_path)
                read = [b"".join(decode(x)) == t.encode() for x, t in zip(found, texts, strict=True)]
                more.append(pa.array(read, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names)

    return rows.mapInArrow(in_task(run, ranks_path, STATES // 4), schema)


def decode_column(encoded: DataFrame, ranks_path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """The text of a column of packed ids, as binary; null ids give null."""

    def run(batches):
        decode = decoder(ranks_path)
        for batch in batches:
            out = [None if x is None else b"".join(decode(np.frombuffer(x, "<u4"))) for x in batch[column]]
            yield batch.assign(**{to: out})

    rows = encoded.drop(to)
    return rows.mapInPandas(run, rows.withColumn(to, F.lit(b"")).schema)


def digests(documents: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, null texts as empty ones.

    The decoded bytes are hashed chunk by chunk, as a stream would bring them.  Rows that repeat get
    a row each, other columns are ignored, and an empty table gives an empty result.
    """

    def run(encode: RememberingEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(ranks_path)
        for part, _, found in slices_encoded(batches, 1, encode):
            decoded = []
            for x in found:
                digest = hashlib.sha256()
                for chunk in decode(x):
                    digest.update(chunk)
                decoded.append(digest.hexdigest())
            columns = {
                "doc_id": part.column(0),
                "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(in_task(run, ranks_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
