"""How much of a text repeats itself, measured with rolling hashes over many texts at once.

For each of several lengths n, a window of n words is a duplicate if the same words stood in an
earlier window of its text; ``dup_n`` is the share of the characters in words that lie inside a
duplicate.  Lines count the same way.  A text whose share exceeds the limit of any length fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.words import IS_SEPARATOR, Slice, mix64, slices, span_hash, windows

#: Published limits for the share of characters in duplicated n-grams and lines.
MOST_IN_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_IN_LINES = 0.20

#: The plain rules: a window length, fewest words, and most repeated words in hundredths.
BASE_WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return hashes ^ mix64(text.astype(np.uint64) + np.uint64(1))


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words that starts at one of ``at``."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measures(part: Slice) -> dict[str, np.ndarray]:
    """One value per text of the slice for each column of ``scored`` but the id."""
    data, begins = part.bytes, (part.bytes & 0xC0) != 0x80
    text_cuts = np.append(part.first, len(data))
    out = {
        "n_words": np.diff(part.word_from),
        "word_chars": _per_text(begins & ~IS_SEPARATOR[data], text_cuts),
        "n_symbols": _per_text(_IS_SYMBOL[data], text_cuts),
    }
    char_total = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
    prefix = part.prefix()

    # lines with a word; a text ends with a line feed of the slice
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    words_before = np.searchsorted(part.word_start, np.append(starts, len(data)))
    worded = words_before[1:] > words_before[:-1]
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(part.first, starts, "right") - 1
    hashes = _in_text(span_hash(prefix, starts, ends), owner)
    again = np.ones(len(starts), bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    chars = char_total[ends] - char_total[starts]
    out["n_dup_lines"] = np.bincount(owner[again], minlength=len(part))
    line_chars = np.bincount(owner, chars, len(part))
    out["dup_lines"] = np.bincount(owner[again], chars[again], len(part)) / np.maximum(line_chars, 1)

    words = span_hash(prefix, part.word_start, part.word_end)
    word_chars = char_total[part.word_end] - char_total[part.word_start]
    for n in sorted({BASE_WINDOW, *MOST_IN_NGRAMS}):
        found, at = windows(words, part.word_text, n)
        _, first, group, count = np.unique(
            _in_text(found, part.word_text[at]), return_index=True, return_inverse=True, return_counts=True
        )
        if n == BASE_WINDOW:
            inside = _covered(at[count[group] > 1], n, len(words))
            out["n_repeat_words"] = _per_text(inside, part.word_from)
        if n in MOST_IN_NGRAMS:
            later = np.ones(len(at), bool)
            later[first] = False
            inside = _covered(at[later], n, len(words))
            out[f"dup_{n}"] = _per_text(word_chars * inside, part.word_from) / np.maximum(out["word_chars"], 1)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    repeats = out["dup_lines"] > MOST_IN_LINES
    for n, most in MOST_IN_NGRAMS.items():
        repeats |= out[f"dup_{n}"] > most
    out["kept"] = ~out["base_failed"] & ~repeats
    return out


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, dup_lines double, " + ", ".join(f"dup_{n} double" for n in MOST_IN_NGRAMS)
)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COLUMNS.split(", ")][1:]
    for batch in batches:
        for part in slices(batch["text"]):
            found = measures(part)
            ids = batch["doc_id"].iloc[part.begin : part.begin + len(part)].array
            yield pd.DataFrame({"doc_id": ids} | {c: found[c] for c in names})


def scored(documents: DataFrame) -> DataFrame:
    """``COLUMNS`` for every row of ``documents``; only ``doc_id`` and ``text`` are read.

    A null text is an empty one: no words, all measures 0, failed for its length.  Rows that repeat get
    a row each, and an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_scored, COLUMNS)
