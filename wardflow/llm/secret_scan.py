"""Secrets in texts: fixed shapes, and strings whose compressed novelty gives them away.

Base spans are three kinds of matches: assignments, access keys and long hexadecimal runs.

Novelty.  A candidate is a long string with letters and digits that follows a sensitive word; in
``name=value`` it is the value, and the name is what it follows.
Parts of it that read as words, dates and short numbers, or whose words the text has elsewhere, are
those of names, paths and addresses and add nothing.  The others are compressed by zstandard, primed
with a dictionary of common code and identifiers and the text on both sides; the bytes they take, per
character of the candidate, are its novelty.  Random strings have no parts that read and are reported
as kind ``novel``.  A copy near before in a plain place makes a string known; later copies don't.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.words import SLICE_BYTES, releasing, row_slices

#: The shapes of the base spans and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: What may be a secret by novelty, and the words that make its surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
#: What an equals sign cuts off, with the padding after it if nothing else follows.
VALUE = re.compile(r"[^=]+(?:=+\Z)?")
LEAST_CANDIDATE = 16
_WORDS = (
    r"(?:keys?|tokens?|secret(?:s|os?|as?|e|es)?|passw[a-z]*|passphrases?|passcodes?|pwds?|credentials?"
    r"|auth(?:ori[sz]ation|entication|ori[sz]e|enticate|[nz])?|bearer|private[nrs]?|signatures?|cookies?|sessions?"
    r"|jwts?|salts?|hash(?:es|ed)?)"
)
#: A boundary is the end of a run of letters or a capital after a small letter.
SENSITIVE = re.compile(
    rf"(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:api|access|app|auth|aws|client|crypt|csrf|db|encryption|git|hmac|host"
    rf"|id|j|license|master|o|my|pgp|gpg|php|private|public|refresh|rsa|secret|session|signing|ssh|ssl|user|xsrf)?{_WORDS}"
    rf"(?:id|file|hash|key|token|secret)?(?:(?![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))",
    re.IGNORECASE | re.ASCII,
)
#: The name of a value right behind it, as in settings; words inside it count without boundaries.
NAMED = re.compile(r"""([A-Za-z0-9_.\[\]-]{1,64})["'\]]*[\x20\t]*(?:=>|:=|[:=])+[\x20\t]*["'\[]*\Z""")
INSIDE = re.compile(
    r"(?<!mon)(?<!tur)(?<!don)(?<!hoc)key(?!note|board|word|stone)|token|secret(?!ar)|passw|pwd|credential"
    r"|auth(?!or(?!i[sz]))|bearer|private|signature|cookie|session|jwt|salt|hash",
    re.IGNORECASE | re.ASCII,
)
#: Characters before a candidate that may hold a sensitive word, and those on either side that
#: prime the compressor.
NEAR, AROUND = 48, 512
#: Least bytes per character of a random string; ``test_text_rules`` measures random strings and names.
NOVEL = 0.4
#: Characters compressed together: fewer than zstandard recodes by their frequency.
PIECE = 48

#: A part of a name: words, then a short number; a number; or a letter or two with a short number.
PART = re.compile(r"[A-Za-z0-9]+")
NAME_PART = re.compile(r"((?:[A-Z]?[a-z]{2,}|[A-Z]{3,})+)\d{0,4}|\d{1,8}|[A-Za-z]{1,2}\d{0,3}|\d{1,4}[A-Za-z]{1,2}(?:\d{1,2})?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Endings and short words without the shape of one.
SHORT_WORDS = frozenset(
    "pdf xls xlsx doc docx ppt pptx txt csv tsv tex tar tgz zip jpg jpeg png gif svg mp html htm xml yml sql www http"
    " https ftp src tmp lib bin usr dev img pkg cfg ssh ssl gz py js ts md rb sh st nd rd th ltd gmbh".split()
)

#: What is common around identifiers in code and settings.
DICTIONARY = (
    "import from return function class public private static const string number boolean true false null none "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users application/json content-type text/plain "
    "user_name first_name last_name created_at updated_at configuration environment_variable database_connection "
    "authorization: bearer access_token refresh_token client_id client_secret api_key secret_key private_key "
    "password passwd credential session_id cookie signature certificate BEGIN PUBLIC KEY END "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx "
    "/usr/local/bin/python /home/user/project/src/main/resources/ C:/Program Files/ version 1.0.0 2024-01-01T00:00:00Z "
).encode()


def _reads(word: str, known: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether a run of letters may be a word of a European language, or is one of ``known``."""
    low = word.lower()
    if low in SHORT_WORDS or low in known:
        return True
    vowels = len(re.findall("[aeiouy]", low))
    return 4 * vowels >= len(low) and 4 * vowels <= 3 * len(low) + 4 and not re.search("[^aeiouy]{5}", low)


def _unread(candidate: str, known: frozenset[str] | set[str] = frozenset()) -> str:
    """The candidate's parts that are no parts of names; numbers are only beside a word or in a row."""
    kept, numbers, reads = [], [], False
    for part in (parts := PART.findall(candidate)):
        m = NAME_PART.fullmatch(part)
        if not m or m[1] and not all(_reads(w, known) for w in WORD.findall(m[1])):
            kept.append(part)
        elif m[1]:
            reads = True
        elif part.isdigit():
            numbers.append(part)
    if not reads and 2 * sum(map(len, numbers)) < sum(map(len, parts)):
        kept = parts
    return "".join(kept)


def novelty(before: str, candidate: str, known: frozenset[str] | set[str] = frozenset()) -> float:
    """Compressed bytes per character that ``candidate`` adds to ``before`` and words ``known``."""
    rest, size = _unread(candidate, known), 0
    prime = DICTIONARY + before.encode("utf-8", "replace")
    for at in range(0, len(rest), PIECE):
        primed = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
        piece = rest[at : at + PIECE].encode()
        size += len(compressor.compress(piece)) - len(compressor.compress(b""))
        prime += piece
    return size / len(candidate)


def _is_sensitive(text: str, start: int) -> bool:
    before = text[max(0, start - NEAR) : start]
    if SENSITIVE.search(text, max(0, start - NEAR), start):
        return True
    named = NAMED.search(before)
    return named is not None and INSIDE.search(named[1]) is not None


def _words(text: str) -> set[str]:
    """The words in a text's plain places."""
    out, at = set(), 0
    for m in CANDIDATE.finditer(text):
        if re.search(r"\d", m[0]) and _is_sensitive(text, m.start()):
            out.update(w.lower() for w in WORD.findall(text[at : m.start()]))
            at = m.end()
    out.update(w.lower() for w in WORD.findall(text[at:]))
    return {w for w in out if len(w) > 2}


class _Judge:
    """Which candidates of one text are random."""

    def __init__(self, text: str):
        self.text, self.found = text, set()

    @functools.cached_property
    def known(self) -> set[str]:
        return _words(self.text)

    def __call__(self, start: int, end: int) -> bool:
        text, found = self.text, self.text[start:end]
        if not (re.search(r"\d", found) and re.search(r"[A-Za-z]", found) and _is_sensitive(text, start)):
            return False
        if found not in self.found:
            after = text[end : end + AROUND].replace(found, " ")
            if novelty(f"{after} {text[max(0, start - AROUND) : start]}", found, self.known) < NOVEL:
                return False
            self.found.add(found)
        return True


def _values(m: re.Match) -> list[tuple[int, int]]:
    """Where the long values between a candidate's equals signs lie, and then the whole candidate."""
    cut = [(m.start() + v.start(), m.start() + v.end()) for v in VALUE.finditer(m[0])]
    return [(a, b) for a, b in cut if LEAST_CANDIDATE <= b - a < len(m[0])] + [m.span()]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all secrets of a whole text, by start and then kind.

    Positions are code points, ends exclusive.  A novel span overlaps no base span.
    """
    text = text if isinstance(text, str) else ""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], s[2]))
    more, at, reach = [], 0, 0
    is_random = _Judge(text)
    for m in CANDIDATE.finditer(text):
        found = []
        for start, end in _values(m):
            while at < len(base) and base[at][0] < end:
                reach = max(reach, base[at][1])
                at += 1
            # the whole comes last: parts may be too short or too plain on their own
            if reach <= start and (end - start < len(m[0]) or not found) and is_random(start, end):
                found.append((start, end, 3))
        more += found
    return [(a, b, KINDS[k]) for a, b, k in sorted(base + more, key=lambda s: (s[0], s[2]))]


def _line(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [spans(text) for text in batch["text"]]
        base = [[s for s in f if s[2] != "novel"] for f in found]
        columns = {f"n_{kind}": [sum(s[2] == kind for s in f) for f in found] for kind in KINDS}
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"].array}
            | columns
            | {
                "base_sha256": [hashlib.sha256(_line(f).encode()).hexdigest() for f in base],
                "spans": [_line(f) for f in found],
            }
        )


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each kind, a digest of the base ones, and all ``spans``.

    One row for each row of ``documents``, repeated ones too; a null text is empty and has none.  Other
    columns are ignored, and an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = ", ".join(f"n_{kind} long" for kind in KINDS)
    return rows.mapInPandas(_scanned, f"doc_id long, {counted}, base_sha256 string, spans string")


def redacted_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` with the secrets in one column replaced; null stays null, columns stay.

    Rows that repeat are treated each on its own, and an empty table stays empty.  Batches go through as
    they come; only the texts of one slice of rows are Python strings at a time.
    """
    rows = documents.withColumn(column, F.col(column).cast("string"))
    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n in row_slices(batch.column(place).cast(pa.string()), SLICE_BYTES):
                part = batch.slice(begin, n)
                texts = part.column(place).cast(pa.string()).to_pylist()
                hidden = pa.array([text if text is None else redacted_text(text) for text in texts], pa.string())
                yield part.set_column(place, column, hidden)

    return rows.mapInArrow(releasing(run), rows.schema)
