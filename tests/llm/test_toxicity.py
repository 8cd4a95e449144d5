import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.odd import documents
from wardflow.llm import toxicity

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
INSULTS = ["blockhead", "numskull", "dimwit", "rotter"]


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randint(1, 3)):
            sentence = rng.choice(sentences)
            sentence.insert(rng.randint(0, len(sentence)), rng.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(s) for s in sentences), toxic))
    return rows


def test_held_out_documents_and_gapped_insults(spark):
    rows = made(900, 1)
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    unseen = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert 150 < len(unseen) < 300
    right = [out[i]["predicted"] == y for i, _, y in rows if i in unseen]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    clean = "ther ononed thati the stion erean"
    base = model.scores([clean])[0]
    for insult in ["blockhead", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "block-head", "BLOCKHEAD", "blockxhead", "nums.kull"]:
        assert model.scores([f"{clean} {insult} erean"])[0] > max(0.3, base), insult
    # far into a long text
    assert model.scores([(clean + " ") * 20_000 + "dimwit"])[0] > 0.3
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out.values())


def test_whole_documents_are_learned_from(spark):
    rng = random.Random(4)
    plain = lambda n: " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(300):
        # one long sentence, or many of them; what makes a document toxic comes last
        text = plain(150) if i % 2 else ". ".join(plain(8) for _ in range(50))
        rows.append((i, f"{text} {rng.choice(INSULTS)}" if i % 3 == 0 else text, int(i % 3 == 0)))
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows])
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    whole = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert (model.columns == whole.columns).all() and np.allclose(model.weights, whole.weights)
    assert np.isclose(model.slope, whole.slope) and np.isclose(model.offset, whole.offset)
    right = (model.scores([t for _, t, _ in rows]) >= 0.3) == np.array([y == 1 for *_, y in rows])
    assert right.mean() > 0.97
    assert list(toxicity.words_of_each(["the cat the", None, "", "cat"])) == [b"\x03\x01\x14\0\x14\x08\x05", b"", b"", b"\x03\x01\x14"]


def test_the_table_is_the_kernel_machine():
    rows = made(150, 2)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    words, _, _ = toxicity.distinct_words([rows[0][1]])
    by_profile = toxicity._profiles(words, model.columns) @ model.weights + model.bias
    assert np.allclose(by_profile, model.word_margins(words), atol=1e-4)


def test_odd_texts_and_labels(spark):
    rows = made(200, 3)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    scores = model.scores([None, "", " \n", "...", "\0", "漢字", "a", "x" * 300_000])
    assert len(scores) == 8 and np.isfinite(scores).all() and len(set(scores[:4].round(9))) == 1
    docs = documents(spark)
    out = toxicity.scored(docs, model)
    assert out.count() == docs.count()
    assert toxicity.scored(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, none)).where("predicted = 1").count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, one)).where("predicted = 1").count() == 0
