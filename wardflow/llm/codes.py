"""Token files of directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of eight bits, lowest first.  Level 1 holds every id's first chunk and a
bitmap of the ids that have more; level 2 holds the second chunks of those, and so on.  A directory
of the set bits before every 512 bits makes a rank query, and so a step to the next level, a
look-up and a count within one block.

A file is a row of a Parquet table: a segment of whole documents in ascending order of their ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardflow.llm.pretokens import RememberingEncoder
from wardflow.sources.scratch import written

#: Ids of a segment; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
RANK_BITS = 512
_MAGIC = b"DAC1"
#: The pre-tokenizer whose pattern ``pretokens`` has.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def encode(ids: np.ndarray) -> bytes:
    """A segment's bytes: header, then for each level its chunks, bitmap and rank directory."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)))
        ranks = np.cumsum(np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32), dtype=np.uint32)
        ranks = np.concatenate(([0], ranks[:-1])).astype("<u4")
        levels.append((rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return _MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """A segment that was read: ``codes[i]`` is one id, ``codes.all()`` are all."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token segment")
        self.n, count = struct.unpack_from("<QI", data, 4)
        at, n = 16, self.n
        self.levels = []
        for _ in range(count):
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            at += n + len(bits) + 4 * blocks
            self.levels.append((chunks, bits, ranks))
            # the ids that go on: those before the last block, and those in it
            n = int(ranks[-1]) + int(np.bitwise_count(bits[-(RANK_BITS // 8) :]).sum())

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i >> 3]
            rest = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + rest.bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for shift, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            at = at[np.unpackbits(bits, count=len(at), bitorder="little").view(bool)]
        return out


class WholeTexts:
    """Ids of texts as the library gives them: cut at the file's added tokens, then by its pattern.

    An added token has its own id wherever it stands.  A text with one that takes in what is beside
    it (``lstrip``, ``rstrip``, ``single_word``) goes to the library whole.
    """

    def __init__(self, tokenizer, plain: RememberingEncoder):
        self.tokenizer, self.plain = tokenizer, plain
        added = tokenizer.get_added_tokens_decoder()
        self.ids = {t.content: np.array([i], np.uint32) for i, t in added.items()}
        # of several at one place the library takes the longest
        either = lambda some: "|".join(re.escape(c) for c in sorted(some, key=lambda c: -len(c))) or r"(?!)"
        self.cut = re.compile(f"({either(self.ids)})")
        beside = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word]
        self.whole = re.compile(either(beside)) if beside else None

    def _joined(self, text: str, cut: list[str], found: list[np.ndarray]) -> np.ndarray:
        if not found:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(found) == 1:
            return found[0]
        between = [self.ids[token] for token in cut[1::2]]
        return np.concatenate([x for pair in zip(found, between, strict=False) for x in pair] + found[-1:])

    def __call__(self, texts) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each slice: the number of its first text, and the ids of each of its texts."""
        texts = [t if isinstance(t, str) else "" for t in texts]
        cuts = [[] if self.whole and self.whole.search(t) else self.cut.split(t) for t in texts]
        held: list[np.ndarray] = []
        at = 0
        slices = itertools.chain(self.plain([part for cut in cuts for part in cut[::2]]), [(0, [])])
        for _, found in slices:
            held += found
            begin, done, used = at, [], 0
            while at < len(texts) and used + (n := len(cuts[at][::2])) <= len(held):
                done.append(self._joined(texts[at], cuts[at], held[used : used + n]))
                at, used = at + 1, used + n
            held = held[used:]
            if done:
                yield begin, done


@functools.cache
def library_encoder(tokenizer_path: str) -> WholeTexts:
    """Ids by the tokenizers library; it gets each distinct piece once, as a word of its own.

    A piece of the tokenizer's own pattern is split no further by it, so ids are the same as for
    whole texts.  Kept for the life of a Python worker.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(tokenizer_path)
    words, sizes = Tokenizer.from_file(tokenizer_path), None
    with open(tokenizer_path, encoding="utf-8") as file:
        stated = json.load(file)
    if stated["pre_tokenizer"] == BYTE_LEVEL and stated["normalizer"] is None:
        # the pieces are cut by this pattern already, and a token has a character for each byte
        words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = tokenizer.get_vocab()
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def by_bytes(some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids, and how many of them precede each piece's end, told by the bytes they stand for."""
        if sizes is None:
            return None
        # the library's fast call names no words
        got = words.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.asarray(got.ids, "<u4")
        ends = np.concatenate(([0], np.cumsum(sizes[ids])))
        stops = np.cumsum([len(piece.encode()) for piece in some])
        if ends[-1] != stops[-1]:
            return None
        upto = np.searchsorted(ends, stops)
        return (ids, upto) if (ends[upto] == stops).all() else None

    def by_words(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = words.encode(some, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(some))
        return np.asarray(got.ids, "<u4"), np.cumsum(counts)

    def run(found: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(found), 20_000):
            some = found[at : at + 20_000]
            ids, upto = by_bytes(some) or by_words(some)
            packed, cuts = ids.tobytes(), [0, *(4 * upto).tolist()]
            out += [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    return WholeTexts(tokenizer, RememberingEncoder(run))


def _segments(batches: Iterator[pd.DataFrame], tokenizer_path: str, end_id: int) -> Iterator[pd.DataFrame]:
    encoder, number = library_encoder(tokenizer_path), 0
    held: list[np.ndarray] = []
    names: list = []
    size, part = 0, None

    def segment() -> pd.DataFrame:
        lengths = list(map(len, held))
        row = {"part": part, "seq": number, "doc_ids": names, "lengths": lengths, "n_ids": sum(lengths)}
        return pd.DataFrame([row | {"codes": encode(np.concatenate(held))}])

    end = np.array([end_id], np.uint32)
    for batch in batches:
        parts, ids_of = batch["part"].tolist(), batch["doc_id"].astype("Int64").tolist()
        for begin, texts in encoder(batch["text"]):
            for i, ids in enumerate(texts, begin):
                if held and size + len(ids) + 1 > SEGMENT_IDS:
                    yield segment()
                    number, held, names, size = number + 1, [], [], 0
                part = parts[i]
                names.append(None if ids_of[i] is pd.NA else ids_of[i])
                held.append(np.concatenate((ids, end)))
                size += len(held[-1])
    if held:
        yield segment()


def segments(documents: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """All texts as segments: ``part, seq, doc_ids, lengths, n_ids, codes``.

    Segments in order of ``part`` and ``seq`` hold the documents in ascending ``doc_id`` (nulls
    first, equal ones by text); ``end_id`` follows each document.  A null text is empty.  Other columns are
    ignored, and an empty table has no segments.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.withColumn("part", F.spark_partition_id()).mapInPandas(
        lambda batches: _segments(batches, tokenizer_path, end_id),
        "part int, seq int, doc_ids array<long>, lengths array<long>, n_ids long, codes binary",
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            ids = Codes(row.codes).all().astype("<u4")
            ends = np.cumsum(np.asarray(row.lengths, np.int64))
            starts = ends - row.lengths
            yield pd.DataFrame(
                {
                    "part": row.part,
                    "seq": row.seq,
                    "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"),
                    "offset": starts,
                    "n_tokens": row.lengths,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)],
                }
            )


def read_back(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a table of segments.

    ``start`` counts the ids before the document: of earlier parts (one row each), of the
    part's earlier segments, and of the segment's earlier documents.
    """
    sizes = files.select("part", "seq", "n_ids")
    earlier = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", earlier.alias("before_part"))
    in_part = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    before = sizes.select("part", "seq", in_part.alias("before")).join(parts, "part")
    found = files.select("part", "seq", "doc_ids", "lengths", "codes").mapInPandas(
        _read, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return found.join(before, ["part", "seq"]).select(
        "doc_id", (F.col("before_part") + F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def written_and_read(documents: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """The documents encoded, written to the shared folder and read back."""
    return read_back(written(segments(documents, tokenizer_path, end_id), "tokens"))
