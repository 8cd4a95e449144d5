import gc
import hashlib
import random
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import AddedToken, Tokenizer

from tests.llm.odd import documents
from wardflow.llm import bpe, codes, pretokens, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
#: Digits as letters: a piece holds either.
LETTERS = str.maketrans("0123456789", "ghijklmnop")
ALPHABET = "'  stmdrevel'l\n\t\r1²½٣é漢字-_. 　\x1c\x85🙂AΏ"


@pytest.fixture(scope="module")
def tik():
    ranks = bpe.Merges.from_file(RANKS).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", " ", "  ", "'s", "x's  y", "<|endoftext|>"] + [
        "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)
    ]


def test_pieces_are_the_patterns(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    for part in pretokens.pieces(texts):
        for i in range(len(part)):
            got = [part.distinct[w] for w in part.which[part.text_from[i] : part.text_from[i + 1]]]
            assert got == pattern.findall(texts[part.begin + i])


def test_transducer_encodes_as_the_library(texts, tik):
    got = [ids.tolist() for _, found in bpe.encoder(RANKS)(texts) for ids in found]
    assert got == [tik.encode_ordinary(t) for t in texts]
    # a whole text read byte by byte, where there are no pieces: merges of one long byte string
    machine = bpe.Transducer(bpe.Merges.from_file(RANKS))
    rng = random.Random(1)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(machine.encode(word), "<u4").tolist() == tik._core_bpe.encode_single_piece(word)


def test_forgetting_states_changes_nothing(monkeypatch, texts, tik):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(pretokens, "SLICE_CHARS", 500)
    machine = bpe.Transducer(bpe.Merges.from_file(RANKS))
    encode = pretokens.RememberingEncoder(lambda found: [machine.encode(p.encode()) for p in found], 40)
    got = [ids.tolist() for _, found in encode(texts[:300]) for ids in found]
    assert got == [tik.encode_ordinary(t) for t in texts[:300]]


def test_streams_decode_between_characters(texts):
    merges = bpe.Merges.from_file(RANKS)
    whole = "".join(texts)
    (_, (ids,)), *_ = bpe.encoder(RANKS)([whole])
    for chunk in (1, 2, 7, 1 << 16):
        parts = list(bpe.Decoder(merges, chunk)(ids))
        assert b"".join(parts) == whole.encode()
        for part in parts:
            part.decode()
    # bytes that are no UTF-8 pass through
    stream = bpe.Utf8Stream()
    data = b"\xff\x80\x80\xe6\xbc"
    assert b"".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.finish() == data


def test_digests(spark, tik):
    docs = documents(spark)
    got = {tuple(r) for r in bpe.digests(docs, RANKS).collect()}
    want = set()
    for r in docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.add(
            (
                r["doc_id"],
                len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256((r["text"] or "").encode()).hexdigest(),
            )
        )
    assert got == want
    assert bpe.digests(docs.limit(0), RANKS).count() == 0


def test_columns_round_trip(spark):
    docs = documents(spark)
    both = bpe.decode_column(bpe.encode_column(docs, RANKS), RANKS)
    assert both.columns == [*(c for c in docs.columns if c != "ids"), "ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())


@pytest.mark.parametrize("most", [1, 255, 256, 70_000, 2**32 - 1])
def test_codes_are_directly_addressable(most):
    ids = np.random.default_rng(most).integers(0, most, 3000, np.uint32, endpoint=True)
    read = codes.Codes(codes.encode(ids))
    assert (read.all() == ids).all() and [read[i] for i in range(3000)] == ids.tolist()
    assert len(codes.Codes(codes.encode(ids[:0]))) == 0
    with pytest.raises(IndexError):
        read[3000]


def test_segments_read_back(spark, monkeypatch):
    docs = documents(spark)
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in codes.written_and_read(docs, LIBRARY).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert codes.written_and_read(docs.limit(0), LIBRARY).count() == 0


def test_added_tokens_have_their_own_ids(spark, monkeypatch, tmp_path, texts):
    end = "<|endoftext|>"
    rng = random.Random(6)
    made = ["a <|endoftext|> b", end, end * 3, f" {end}\n {end}", f"{end[:-1]}{end}", "<|endoftext|", f"x's{end}'s", f"漢{end}🙂 "]
    made += ["".join(rng.choice([end, "a", " ", "  ", "\n", "'s", "<|", "|>", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    made += texts[:500]
    rows = [(i, t, "s") for i, t in enumerate(made, 100)]
    docs = documents(spark).unionByName(documents(spark, rows)).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    library = Tokenizer.from_file(LIBRARY)
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    want, start = set(), 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.add((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in codes.written_and_read(docs, LIBRARY).collect()} == want
    # slices that end inside a text, and tokens that take in what is beside them
    monkeypatch.setattr(pretokens, "SLICE_CHARS", 7)
    library.add_special_tokens([AddedToken("<|left|>", lstrip=True), AddedToken("<|end"), AddedToken("<|word|>", single_word=True)])
    library.save(path := str(tmp_path / "more.json"))
    made += [f"a  <|left|> b{end}", "<|endof", "x<|word|> <|word|> y", "<|end<|endoftext|>", None]
    got = list(codes.library_encoder(path)(made))
    assert [begin for begin, _ in got] == [sum(len(f) for _, f in got[:i]) for i in range(len(got))]
    assert [ids.tolist() for _, f in got for ids in f] == [library.encode(t or "", add_special_tokens=False).ids for t in made]


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 18])
def test_counts_are_stitched_across_blocks(spark, tik, block):
    rows = [(i, t, "s") for i, t in enumerate(["", "a b c d e f g h", None, "x", "", "one two three four five " * 9])]
    docs = documents(spark, [*rows, (None, "no id", "s"), (3, "x", "s")])
    files = token_counts.token_files(docs, RANKS, block=block)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.counts(files).collect()), key=str)
    assert got == sorted(((r["doc_id"], len(tik.encode_ordinary(r["text"] or ""))) for r in docs.collect()), key=str)
    assert token_counts.counts(token_counts.token_files(docs.limit(0), RANKS)).count() == 0


def test_ids_that_do_not_fit_are_refused(spark):
    docs = documents(spark)
    for end_id in (50_255, 70_000):
        with pytest.raises(ValueError, match="16 bits"):
            token_counts.token_files(docs, RANKS, end_id)


def test_the_transducer_leaves_nothing_to_the_garbage_collector():
    """Nothing is collected while pieces are encoded, and cleared states go without it."""
    runs, seen = [], lambda phase, info: runs.append(phase)
    encoder = bpe.new_encoder(RANKS)
    gc.collect()
    gc.callbacks.append(seen)
    try:
        encoder.encode([f"w{i * 7919:x}q" for i in range(5_000)])
    finally:
        gc.callbacks.remove(seen)
    assert len(runs) <= 2 and gc.isenabled()
    transducer = bpe.Transducer(bpe._merges(RANKS))
    transducer.encode(b"states that lead to states")
    gc.collect()
    states = lambda: sum(isinstance(x, bpe._State) for x in gc.get_objects())
    before, made = states(), len(transducer.states)
    gc.disable()
    try:
        transducer.clear()
        assert made and states() == before - made
    finally:
        gc.enable()


def test_pieces_are_told_apart_by_their_bytes():
    """As words of one call without the library's word numbers, and with them if the bytes don't add up."""
    tokenizer = Tokenizer.from_file(LIBRARY)
    texts = ["a", " Größe", "日本語 text", "", " \t x\n\n", "don't <|endoftext|> it's", "é" * 40, "🙂🙂 ok"]
    found = [ids.tolist() for _, some in codes.library_encoder(LIBRARY)(texts) for ids in some]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_pieces_are_small_and_told_apart(monkeypatch):
    """Pieces are remembered in arrays, without Python objects for each, and known by their characters."""
    encode = pretokens.RememberingEncoder(lambda found: [p[-1].encode("utf-32-le") for p in found], 1_000_000)
    list(encode(["warm up"]))
    gc.collect()
    tracemalloc.start()
    try:
        for k in range(0, 100_000, 20_000):
            list(encode([" ".join(f"w{i:x}".translate(LETTERS) for i in range(k, k + 20_000))]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 100_000 * 100, held
    # all pieces of one hash, one in each slice
    monkeypatch.setattr(pretokens, "SLICE_CHARS", 1)
    monkeypatch.setattr(pretokens, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    asked = []
    encode = pretokens.RememberingEncoder(lambda found: asked.extend(found) or [p.encode("utf-32-le") for p in found])
    texts = ["ab", "cd", "abc", "ab", "é", "cd"]
    found = [ids.tolist() for _, some in encode(texts) for ids in some]
    assert found == [list(map(ord, t)) for t in texts] and asked[:2] == ["ab", "cd"] and asked.count("ab") == 1


def test_classes_are_the_categories():
    kinds = {"L": pretokens.LETTER, "N": pretokens.NUMBER}
    table = [kinds.get(unicodedata.category(chr(c))[0], pretokens.OTHER) for c in range(0x110000)]
    for c in pretokens.WHITE_SPACE:
        table[c] = pretokens.SPACE
    assert (pretokens._classes() == np.array(table)).all()


def test_a_worker_keeps_nothing_of_its_task(spark):
    """States that lead to one another are freed with the task, and so is the rank file."""
    docs = documents(spark).repartition(8)
    assert bpe.encode_column(docs, RANKS, check="decodes").where("NOT decodes").count() == 0

    def left(batches):
        held = sum(isinstance(x, (bpe._State, bpe.Merges)) for x in gc.get_objects())
        for batch in batches:
            yield batch.assign(id=held)

    assert spark.range(0, 64, 1, 8).mapInPandas(left, "id long").agg({"id": "max"}).first()[0] == 0


@pytest.mark.parametrize("query", ["op2", "op10"])
def test_counting_and_digests_leave_nothing_in_their_workers(spark, query):
    docs = documents(spark).repartition(8)
    found = bpe.digests(docs, RANKS) if query == "op10" else token_counts.token_files(docs, RANKS)
    assert found.count()

    def left(batches):
        held = sum(isinstance(x, (bpe._State, bpe.Merges)) for x in gc.get_objects())
        for batch in batches:
            yield batch.assign(id=held)

    assert spark.range(0, 64, 1, 8).mapInPandas(left, "id long").agg({"id": "max"}).first()[0] == 0


def test_states_are_small():
    transducer = bpe.Transducer(bpe.Merges.from_file(RANKS))
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdehinorst", k=9)).encode() for _ in range(6_000)]
    gc.collect()
    tracemalloc.start()
    try:
        for word in words:
            transducer.encode(word)
        transducer.merges.forget()
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 700 * len(transducer.states), held / len(transducer.states)


def test_a_batch_goes_through_slice_by_slice(monkeypatch):
    """Of a large batch only one slice of texts is made into strings before rows are given out."""
    monkeypatch.setattr(bpe, "SLICE_BYTES", 100)
    taken = []

    def encode(texts):
        taken.append(len(texts))
        yield 0, [np.zeros(len(t), np.uint32) for t in texts]

    texts = ["x" * 30, None, "", "y" * 60, "é" * 300, "z"]
    columns = [pa.array(range(6), pa.int64()), pa.array(texts), pa.array([4] * 6, pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "part"])
    blocks = token_counts._packed(encode, iter([batch]), 50256, 8)
    first = next(blocks)
    assert taken == [4] and first.to_pylist() == [{"file": 4, "block": 0, "ids": bytes(16), "ended": []}]
    rows = [first.to_pylist()[0], *(row for b in blocks for row in b.to_pylist())]
    assert taken == [4, 1, 1] and [i for row in rows for i in row["ended"]] == [*range(6)]
    assert [row["block"] for row in rows] == [*range(len(rows))]
    assert sum(len(row["ids"]) for row in rows) == 2 * (sum(len(t or "") for t in texts) + 6)
