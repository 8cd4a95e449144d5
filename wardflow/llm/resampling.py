"""Importance resampling towards a target by hashed word runs, with bit-sliced sums.

Features are all runs of one and two words, hashed to 10,000 buckets by CRC-32.  What the documents
and the target hold in each bucket gives the bucket's gain, a signed integer.

Weights.  A document's bucket counts are written as bit planes: bit b of plane j is bit j of the count
in bucket b.  The gains, in two's complement, are planes as well, the highest one negative.  For each
pair of planes the bits that both have are counted; these counts times 2**(j + k), summed, are exactly
the sum of count times gain, without a multiplication for any feature.

Draw.  A document's score is its weight plus seeded Gumbel noise in thousandths, an integer.  A count for
each score, of which there are some ten thousands however many rows there are, says how many rows stand
before it; inside a score rows are ordered by id.  So no window sees more than the rows of one score,
and noise spreads even equal weights over thousands of scores.

Texts longer than ``SLICE_BYTES`` are cut at separators; the next piece begins with the last word of the
one before, so that memory doesn't grow with a text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardflow.sources.scratch import written

BUCKETS = 10_000
#: So many per cent of the documents with at least so many words are drawn.
PERCENT, LEAST_WORDS = 25, 20
SEED = 7
#: Bytes and texts that are handled in one go.
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 1024

WORDS64 = -(-BUCKETS // 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of words, after lower-casing: digits, a-z and all bytes of other characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_SEPARATORS = bytes(np.flatnonzero(~IS_WORD).tolist())
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Words up to this length are hashed side by side, longer ones one by one.
SHORT_WORD = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _shift_tables() -> list[np.ndarray]:
    """For each power of two: what that many zero bytes make of a CRC, by its four bytes."""
    tables = []
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    unit = (unit >> np.uint32(8)) ^ _CRC[unit & np.uint32(0xFF)]  # one zero byte, bit by bit
    for _ in range(32):
        table = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                table[place, has] ^= unit[8 * place + bit]
        tables.append(table)
        unit = _shifted_by(table, unit)
    return tables


def _shifted_by(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    return (
        table[0][crc & low]
        ^ table[1][(crc >> np.uint32(8)) & low]
        ^ table[2][(crc >> np.uint32(16)) & low]
        ^ table[3][crc >> np.uint32(24)]
    )


_SHIFT = _shift_tables()


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``: byte by byte, for all spans at once."""
    lengths = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -SHORT_WORD) :]
    at, some = start[order], crc[order]
    active = np.searchsorted(-lengths[order], -np.arange(SHORT_WORD + 1), "left")  # spans longer than k bytes
    for k in range(int(lengths[order].max(initial=0))):
        n = active[k]
        some[:n] = (some[:n] >> np.uint32(8)) ^ _CRC[(some[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)]
    crc[order] = ~some
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc


def appended(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts one after the other, from the CRC of each."""
    out, k, left = first.copy(), 0, second_length.astype(np.int64)
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _shifted_by(_SHIFT[k], out[some])
        left, k = left >> 1, k + 1
    return out ^ second


class Pieces:
    """Some lower-cased pieces of texts: their words' owners, and the buckets of their features.

    ``goes_on`` marks pieces whose first word was the last of the piece before; it counts in runs only.
    """

    def __init__(self, pieces: list[bytes], goes_on: list[bool]):
        data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        last = np.cumsum([len(p) + 1 for p in pieces])
        inside = IS_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        start, end = edges[::2], edges[1::2]
        owner = np.searchsorted(last, start, "right")
        crc = word_crcs(data, start, end)
        new = np.ones(len(start), bool)
        begins = np.searchsorted(owner, np.flatnonzero(goes_on))
        new[begins[begins < len(new)]] = False
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        space = np.full(len(pair), zlib.crc32(b" "), np.uint32)
        one = np.ones(len(pair), np.int64)
        runs = appended(appended(crc[pair], space, one), crc[pair + 1], (end - start)[pair + 1])
        self.n_words = np.bincount(owner[new], minlength=len(pieces))
        self.owner = np.concatenate((owner[new], owner[pair]))
        self.bucket = np.concatenate((crc[new], runs)).astype(np.int64) % BUCKETS


def _cut(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """The pieces of a long text, and whether each begins with the last word of the one before."""
    at, carried = 0, b""
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text):
            found = _SEPARATOR.search(text, stop)
            stop = found.start() if found else len(text)
        piece = carried + b" " + text[at:stop] if carried else text[at:stop]
        yield piece, bool(carried)
        last = piece.rstrip(_SEPARATORS)
        begin = len(last)
        while begin and IS_WORD[last[begin - 1]]:
            begin -= 1
        carried, at = last[begin:], stop


def counted(texts: list[str | None], size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of consecutive texts: the first one's number, each text's words, and its buckets' counts.

    Counts come as sorted keys (text in the run * ``BUCKETS`` + bucket) with a number each.
    """
    held: list[bytes] = []
    begin, filled = 0, 0

    def run():
        found = Pieces(held, [False] * len(held))
        return begin, found.n_words, *np.unique(found.owner * BUCKETS + found.bucket, return_counts=True)

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace").translate(_LOWER) if isinstance(text, str) else b""
        if held and (filled + len(data) > size or len(held) == SLICE_TEXTS):
            yield run()
            begin, held, filled = i, [], 0
        if len(data) <= size:
            held.append(data)
            filled += len(data)
            continue
        n_words, counts = 0, np.zeros(BUCKETS, np.int64)
        for piece, goes_on in _cut(data, size):
            found = Pieces([piece], [goes_on])
            n_words += found.n_words[0]
            counts += np.bincount(found.bucket, minlength=BUCKETS)
        keys = np.flatnonzero(counts)
        yield i, np.array([n_words]), keys, counts[keys]
        begin = i + 1
    if held:
        yield run()


def planes(keys: np.ndarray, counts: np.ndarray, texts: int) -> list[np.ndarray]:
    """The counts' bit planes, lowest first: one row of 64-bit words for each text."""
    out = []
    for j in range(int(counts.max(initial=0)).bit_length()):
        bits = np.zeros((texts, WORDS64 * 64), bool)
        has = keys[(counts >> j) & 1 == 1]
        bits[has // BUCKETS, has % BUCKETS] = True
        out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Two's complement planes of the gains, each with the number its bits stand for."""
    width = int(np.abs(gains).max(initial=0)).bit_length() + 1
    keys = np.arange(BUCKETS)
    bits = planes(keys, gains & ((1 << width) - 1), 1)
    return [(-(1 << k) if k == width - 1 else 1 << k, plane) for k, plane in enumerate(bits)]


def sliced_sums(keys: np.ndarray, counts: np.ndarray, texts: int, gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Each text's sum of count times gain."""
    total = np.zeros(texts, np.int64)
    for j, plane in enumerate(planes(keys, counts, texts)):
        for value, gain in gains:
            total += (value << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return total


def _texts_of(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def bucket_totals(rows: DataFrame) -> np.ndarray:
    """What all texts of ``rows`` hold in each bucket: ``BUCKETS`` sums, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, keys, counts in counted(_texts_of(batch)):
                np.add.at(total, keys % BUCKETS, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, floored."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(documents: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    in_planes = gain_planes(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, n_words, keys, counts in counted(_texts_of(batch)):
                features = np.maximum(2 * n_words - 1, 0)
                total = sliced_sums(keys, counts, len(n_words), in_planes)
                weight = total // np.maximum(features, 1)
                arrays = [ids.slice(begin, len(n_words)), *map(pa.array, (n_words, features, weight))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` of ``weighted`` with ``score`` and ``rank``; the rank of rows that aren't drawn is null."""
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    share = (F.conv(key, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(share)))
    scored = written(rows.withColumn("score", F.col("weight") + noise), "scored")
    can_be = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    by_score = scored.where(can_be).groupBy("score").agg(F.count(F.lit(1)).alias("held"))
    # a row for each score: bounded by the range of weights and noise
    upto = F.sum("held").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    places = by_score.select("score", (upto - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy()).alias("all"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "n_words")
    ranked = scored.where(can_be).withColumn("place", F.row_number().over(order)).join(places, "score")
    rank = (F.col("before") + F.col("place")).cast("long")
    most = F.floor(F.col("all") * percent / 100)
    ranked = ranked.withColumn("rank", F.when(rank <= most, rank))
    others = scored.where(~can_be | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*others.columns).unionByName(others)


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``documents``.

    Both tables need a column ``text``; a null text has no words, no features and weight 0.  Rows
    without ``doc_id`` have no noise: null score and rank, and they don't count among those to draw
    from.  Rows that repeat an id have the same noise and are drawn each on its own.  An
    empty target leaves all documents' gains to the smoothing; an empty table gives an empty result.
    """
    gains = gains_of(bucket_totals(documents), bucket_totals(target))
    found = drawn(weighted(documents, gains), percent, seed)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
