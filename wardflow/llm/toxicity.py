"""Toxicity by a support vector machine with a subsequence string kernel.

Kernel.  Two words are as similar as the gapped subsequences of four characters they share: each
occurrence counts ``DECAY`` to the power of the characters it skips, at most three, and a word's
values are divided by the norm that its length gives.  A word with characters put in or left out
thus keeps much of its similarity.  Before, case is folded, signs inside words are left out, and
letters that stand alone one by one are joined, so that spaced and dotted insults are words.

Nystroem landmarks.  Words that labelled documents tell apart, and common ones, span the space; a
word's coordinates are its kernel values with the landmarks, whitened by the landmarks' own
kernel matrix.  A linear machine is trained on them with a squared hinge loss.

Training.  Labelled documents are learned from whole, by their distinct words.  Words of clean
documents are negative; of each toxic document the word that scores highest is its witness and
positive.  Witnesses are chosen by word counts first and then by the machine, which is fitted again.
The scores of whole documents become probabilities by a logistic fit.

Scoring.  The machine is linear in the kernel and the kernel in its subsequences, so both fold into
one table of subsequence weights.  A text's score is that of its highest word.  Every character of
every text is read; words that occur often are scored once per slice of texts.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardflow.llm.words import mix64, prefix_hash, releasing, row_slices, span_hash

DECAY, SKIPS, ORDER = 0.75, 3, 4
LANDMARKS = 256
#: The classifier is fitted on at most so many labelled documents of each label, chosen by a hash
#: of their id, and the machine on so many of their distinct words, the commonest.
TRAIN_DOCUMENTS, TRAIN_WORDS = 2000, 40_000
#: Characters of texts whose words are found in one go; a longer text is handled alone.
SLICE_CHARS = 1 << 18
THRESHOLD = 0.3
ROUNDS = 3
#: Symbols of a word; longer ones are scored in overlapping pieces of this length.
WORD_SYMBOLS = 24

#: Offsets of a subsequence's later characters and the factor for what it skips.
GAPS = [
    (offsets, DECAY ** (offsets[-1] - ORDER + 1))
    for offsets in itertools.combinations(range(1, ORDER + SKIPS), ORDER - 1)
]
CODES = 32
SPACE, SIGN, PAD = 0, 30, 31


@functools.cache
def _folded() -> np.ndarray:
    """Code points up to 0xFFFF to symbols: space, 26 letters, three groups of other letters and
    digits, and signs."""
    table = np.full(0x10000, SIGN, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if ch.isspace():
            table[c] = SPACE
        elif kind in "LN":
            low = ch.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 3
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, words apart by one space, ``PAD`` at each end; and where the ends are."""
    whole = "\0".join(t.replace("\0", " ") if isinstance(t, str) else "" for t in texts) + "\0"
    points = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    codes = _folded()[points]
    ends = points == 0
    codes[ends] = PAD
    # signs between letters go, other signs are space
    sign = codes == SIGN
    codes[sign] = SPACE
    letter = (codes != SPACE) & (codes != PAD)
    place = np.arange(len(codes))
    before = np.maximum.accumulate(np.where(sign, 0, place))
    after = np.minimum.accumulate(np.where(sign, len(codes) - 1, place)[::-1])[::-1]
    keep = ~(sign & letter[before] & letter[after])
    codes = codes[keep]
    # one space for a run of them
    space = codes == SPACE
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    # a space between two letters that both stand alone goes
    space = codes == SPACE
    edge = space | (codes == PAD)
    left, right = np.concatenate(([True], edge[:-1])), np.concatenate((edge[1:], [True]))
    alone = ~edge & left & right
    codes = codes[~(space & np.concatenate(([False], alone[:-1])) & np.concatenate((alone[1:], [False])))]
    return codes, np.flatnonzero(codes == PAD)


def distinct_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts' distinct words as symbols; which one stands at each place; the text of each place."""
    codes, ends = symbols(texts)
    inside = np.concatenate(([False], (codes != SPACE) & (codes != PAD)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    half = WORD_SYMBOLS // 2
    pieces = np.maximum(1, -(-(stop - start - half) // half))
    begin = np.repeat(start, pieces) + half * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    finish = np.minimum(begin + WORD_SYMBOLS, np.repeat(stop, pieces))
    hashes = span_hash(prefix_hash(mix64(codes.astype(np.uint64) + np.uint64(1))), begin, finish)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    data = codes.tobytes()
    return [data[a:b] for a, b in zip(begin[first].tolist(), finish[first].tolist(), strict=True)], which, np.searchsorted(ends, begin)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text or "")
        if size > SLICE_CHARS or i == len(texts):
            yield begin, i
            begin, size = i, 0


def words_of_each(texts: list[str | None]) -> Iterator[bytes]:
    """For each text its distinct words, in order, between spaces."""
    for a, b in _slices(texts):
        words, which, owner = distinct_words(texts[a:b])
        place = np.unique(owner * max(1, len(words)) + which)
        ends = np.searchsorted(place, np.arange(1, b - a + 1) * max(1, len(words)))
        held = np.split(place % max(1, len(words)), ends[:-1])
        yield from (bytes([SPACE]).join(sorted(words[w] for w in some.tolist())) for some in held)


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words between spaces in one array, far enough apart; where each starts; their norms."""
    gap = bytes([SPACE]) + bytes([PAD]) * (ORDER + SKIPS) + bytes([SPACE])
    codes = np.frombuffer(bytes([SPACE]) + gap.join(words) + gap, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(np.concatenate(([0], lengths[:-1] + len(gap))))
    return codes, starts, _norms()[np.minimum(lengths, WORD_SYMBOLS)]


@functools.cache
def _norms() -> np.ndarray:
    """For each word length the root of the sum of squares of its subsequences' factors."""
    sizes = np.arange(WORD_SYMBOLS + 1) + 2
    total = sum(factor**2 * np.maximum(sizes - offsets[-1], 0) for offsets, factor in GAPS)
    return np.sqrt(np.maximum(total, 1.0)).astype(np.float32)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of gaps: the packed subsequence that starts at each symbol, and its factor."""
    n = len(codes) - ORDER - SKIPS
    wide = codes.astype(np.int32)
    head = wide[:n] << 15
    for (a, b, c), factor in GAPS:
        yield head | wide[a : a + n] << 10 | wide[b : b + n] << 5 | wide[c : c + n], factor


def _has_no_padding(packed: np.ndarray) -> np.ndarray:
    used = np.ones(len(packed), bool)
    for shift in (0, 5, 10, 15):
        used &= (packed >> shift) % CODES != PAD
    return used


def _profiles(words: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Each word's normed weights over the subsequences in ``columns`` (sorted)."""
    codes, starts, norms = _laid_out(words)
    out = np.zeros((len(words), len(columns)), np.float32)
    owner = np.searchsorted(starts, np.arange(len(codes)), "right") - 1
    place = np.full(CODES**ORDER, -1, np.int32)
    place[columns] = np.arange(len(columns))
    for packed, factor in _subsequences(codes):
        column = place[packed]
        at = np.flatnonzero(column >= 0)
        np.add.at(out, (owner[at], column[at]), np.float32(factor))
    return out / norms[:, None]


@dataclass
class Model:
    """``columns``/``weights``: the table of subsequence weights; ``slope``/``offset``: the logistic fit."""

    columns: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    @functools.cached_property
    def table(self) -> np.ndarray:
        table = np.zeros(CODES**ORDER, np.float32)
        table[self.columns] = self.weights
        return table

    def word_margins(self, words: list[bytes]) -> np.ndarray:
        codes, starts, norms = _laid_out(words)
        n = len(codes) - ORDER - SKIPS
        total = np.zeros(n, np.float32)
        step = 1 << 15
        for at in range(0, n, step):
            for packed, factor in _subsequences(codes[at : min(at + step, n) + ORDER + SKIPS]):
                total[at : at + step] += np.float32(factor) * self.table[packed]
        return np.add.reduceat(total, starts) / norms + np.float32(self.bias)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Each text's highest word; a text without words has the margin of no similarity."""
        out = np.full(len(texts), self.bias, np.float32)
        words, which, owner = distinct_words(texts)
        if words:
            np.maximum.at(out, owner, self.word_margins(words)[which])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each text, computed over slices of them."""
        parts = [self.margins(texts[a:b]) for a, b in _slices(texts)]
        return self.probability(np.concatenate(parts).astype(np.float64)) if parts else np.zeros(0)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def _fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Squared hinge loss with a ridge, by Newton steps on the examples inside the margin.

    The last of ``x``'s columns is the constant; y is 1 or -1.
    """
    w = np.zeros(x.shape[1]) if start is None else start
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(15):
        active = y * (x @ w) < 1
        xa, ca = x[active], weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), xa.T @ (ca * y[active]))
        done = np.allclose(new, w, atol=1e-4)
        w = new
        if done:
            break
    return w


def _fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a probability, by Newton steps, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((margin, np.ones_like(margin)), 1).astype(np.float64)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-2 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str], labels: np.ndarray, share: float | None = None, size: int = LANDMARKS) -> Model:
    """A model from labelled texts and their 0/1 labels; see ``fit_words``."""
    return fit_words(list(words_of_each(texts)), labels, share, size)


def fit_words(texts: list[bytes], labels: np.ndarray, share: float | None = None, size: int = LANDMARKS) -> Model:
    """A model from the distinct words of labelled texts, as ``words_of_each`` gives them.

    ``share`` is the share of toxic documents where it differs from that of ``labels``.  Without
    words, or without texts of both labels, every score is that share.
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    share = float(np.mean(y > 0)) if share is None and len(y) else share or 0.0
    held = [text.split(bytes([SPACE])) if text else [] for text in texts]
    words = sorted(set(itertools.chain.from_iterable(held)))
    number = {word: i for i, word in enumerate(words)}
    which = np.fromiter((number[w] for some in held for w in some), np.int64)
    owner = np.repeat(np.arange(len(held)), [len(some) for some in held]).astype(np.int64)
    if not words or len(set(y)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    # in how many texts of each label a word occurs
    n_toxic = np.bincount(which[y[owner] > 0], minlength=len(words))
    n_clean = np.bincount(which[y[owner] < 0], minlength=len(words))
    by_place = np.arange(len(words))
    common = np.lexsort((by_place, -(3 * n_toxic + n_clean)))[:TRAIN_WORDS]
    lean = np.log((n_toxic + 0.5) / (np.sum(y > 0) + 1)) - np.log((n_clean + 0.5) / (np.sum(y < 0) + 1))
    strength = lean * np.sqrt(n_toxic)
    landmarks = np.unique(np.concatenate((np.lexsort((by_place, -strength))[: size * 3 // 4], common[: size // 4])))
    chosen = [words[i] for i in landmarks]
    codes, _, _ = _laid_out(chosen)
    columns = np.unique(np.concatenate([packed[_has_no_padding(packed)] for packed, _ in _subsequences(codes)]))
    profiles = _profiles(chosen, columns)
    values, vectors = np.linalg.eigh((profiles @ profiles.T).astype(np.float64))
    good = values > 1e-4 * values[-1]
    project = (profiles.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)
    x = np.ones((len(common), project.shape[1] + 1), np.float32)
    for at in range(0, len(common), 500):
        x[at : at + 500, :-1] = _profiles([words[i] for i in common[at : at + 500]], columns) @ project
    # places of common words in toxic texts, by text
    rank = np.full(len(words), -1)
    rank[common] = np.arange(len(common))
    seen = (rank[which] >= 0) & (y[owner] > 0)
    word_at, text_at = rank[which[seen]], owner[seen]
    score, w = strength[common], None
    negative = n_clean[common] > 0
    for _ in range(ROUNDS):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text_at, score[word_at])
        witness = score[word_at] >= best[text_at]
        n_witness = np.bincount(word_at[witness], minlength=len(common))
        # a word that is seen oftener in clean texts than as a witness is no witness
        positive = n_witness > n_clean[common]
        use = positive | negative
        weight = np.where(positive, 3.0 * np.sqrt(n_witness), np.sqrt(1.0 + n_clean[common])).astype(np.float32)
        w = _fit_machine(x[use], np.where(positive, 1.0, -1.0).astype(np.float32)[use], weight[use], w)
        score = x @ w
    model = Model(columns, (project @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)
    # a whole text's margin is that of its highest word
    margins = np.full(len(texts), model.bias, np.float32)
    np.maximum.at(margins, owner, model.word_margins(words)[which])
    model.slope, model.offset = _fit_logistic(margins.astype(np.float64), y)
    # from the sample's share of toxic texts to the documents'
    odds = lambda p: np.log(max(p, 1e-4) / max(1 - p, 1e-4))
    model.offset += float(odds(share) - odds(float(np.mean(y > 0))))
    return model


def train(documents: DataFrame, labelled: DataFrame) -> Model:
    """A model from ``labelled`` rows ``doc_id, toxic``; null or other labels than 0 and 1 are left out.

    At most ``TRAIN_DOCUMENTS`` of each label, by a hash of the id, are learned from; the distinct
    words of their whole texts reach the driver.  A document that is labelled twice counts once, as
    toxic if any row says so.
    """
    one = (
        labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    some = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS) for t in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most twice TRAIN_DOCUMENTS rows of two numbers
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.where("text IS NOT NULL").join(chosen, "id").select("id", "toxic", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "toxic"]].assign(words=list(words_of_each(batch["text"].tolist())))

    found = rows.withColumn("toxic", F.col("toxic").cast("int")).mapInPandas(releasing(run), "id long, toxic int, words binary").collect()
    found = sorted(((r["id"], bytes(r["words"]), r["toxic"]) for r in found))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_words([words for _, words, _ in found], np.array([toxic for *_, toxic in found], int), share)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row; only the text enters the score.

    A null, empty or wordless text has the score of one without any similarity.  Rows that repeat get a
    row each, other columns are ignored, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.scores(batch["text"].tolist())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].array, "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(releasing(run), "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from training: a quarter of all ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that the model doesn't reject, with all their columns.

    A null, empty or wordless text has the score of one without any similarity.  Rows that repeat are
    judged each on its own, other columns pass as they are, and an empty table gives an empty result.
    Batches go through as they come; only the texts of one slice of rows are Python strings at a time.
    """
    schema = documents.schema
    place = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            for begin, rows in row_slices(texts, SLICE_CHARS):
                score = model.scores(texts.slice(begin, rows).to_pylist())
                yield batch.slice(begin, rows).filter(pa.array(score < THRESHOLD))

    return documents.mapInArrow(releasing(run), schema)
