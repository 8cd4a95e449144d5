import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.odd import documents
from wardflow.llm import resampling

LOWER = {i: i + 32 for i in range(65, 91)}


def buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), Counter(zlib.crc32(f.encode()) % 10000 for f in runs)


def by_brute_force(rows, target):
    """(doc_id, n_features, weight, score, rank) of each row."""
    each = [(i, *buckets(text)) for i, text in rows]
    s, t = (sum(some, Counter()) for some in ((c for *_, c in each), (buckets(x)[1] for x in target)))
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(10000)]
    out = []
    for i, n_words, counts in each:
        n = sum(counts.values())
        weight = sum(gain[b] * c for b, c in counts.items()) // n if n else 0
        share = None if i is None else (int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append((i, n, weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log(share))), n_words))
    can_be = sorted((-s, i, n, w) for i, n, w, s, n_words in out if n_words >= 20 and i is not None)
    place = {}
    for k, (score, i, n, w) in enumerate(can_be[: 25 * len(can_be) // 100], 1):
        place.setdefault((i, n, w, -score), []).append(k)
    return sorted(((i, n, w, s, place[i, n, w, s].pop() if place.get((i, n, w, s)) and i is not None else None) for i, n, w, s, _ in out), key=str)


def check(spark, docs, target):
    found = resampling.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    want = by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], target)
    assert sorted(map(tuple, found.collect()), key=str) == want
    return want


def test_odd_rows(spark):
    docs = documents(spark)
    check(spark, docs, ["one two three", None, "", "W1 w2 W3"])
    check(spark, docs, [])
    empty = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), empty).count() == 0


def test_draws_what_is_near_the_target(spark):
    rng = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(80)] for k in "pqr"]
    rows = [(i, " ".join(rng.choices(kinds[i % 3], k=rng.choice([5, 30, 90]))), "s") for i in range(900)]
    rows += [(i, rows[4][1], "s") for i in (4, 4, 903, 904)]
    want = check(spark, documents(spark, rows), [" ".join(rng.choices(kinds[1], k=400))])
    drawn = [i for i, *_, rank in want if rank]
    # a third of the documents are of the target's kind
    assert np.mean([i % 3 == 1 for i in drawn if i < 900]) > 0.5


def test_crc_of_spans_and_runs():
    rng = random.Random(2)
    words = [bytes(rng.choices(range(97, 123), k=n)) for n in [1, 2, 3, 7, 47, 48, 49, 500, 70_000, 5]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    crc = resampling.word_crcs(data, start, end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    both = resampling.appended(crc[:-1], crc[1:], (end - start)[1:])
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_pieces_of_long_texts_add_up():
    rng = random.Random(9)
    long = "".join(rng.choice(["Ab", "é9", " ", "--", "x" * 30, "\n", "漢"]) for _ in range(4000))
    texts = ["one two", None, long, "", "tail Words here", "y" * 300, " " * 500]
    want = [buckets(t) for t in texts]
    for size in (1, 7, 64, 1000, 1 << 20):
        got = {}
        for begin, n_words, keys, counts in resampling.counted(texts, size):
            for k, n in enumerate(n_words.tolist()):
                mine = keys // 10000 == k
                got[begin + k] = n, Counter(dict(zip((keys[mine] % 10000).tolist(), counts[mine].tolist())))
        assert [got[i] for i in range(len(texts))] == want


def test_sliced_sums_are_exact():
    rng = np.random.default_rng(4)
    gains = rng.integers(-20_000, 20_000, 10_000)
    counts = np.zeros((5, 10_000), np.int64)
    counts[1, 9_999] = 3
    counts[2] = rng.integers(0, 70_000, 10_000)
    counts[4, :50] = 1
    keys = np.flatnonzero(counts)
    found = resampling.sliced_sums(keys, counts.ravel()[keys], 5, resampling.gain_planes(gains))
    assert found.tolist() == (counts @ gains).tolist()
    assert resampling.sliced_sums(keys[:0], keys[:0], 2, resampling.gain_planes(gains * 0)).tolist() == [0, 0]
