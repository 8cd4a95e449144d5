import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.odd import documents
from wardflow.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(hashes):
    """The root over some digests, and for each the steps (left, right) up to it."""
    steps, owners = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        new, new_owners = [], []
        for at in range(0, len(hashes), 8):
            run = hashes[at : at + 8]
            for k, some in enumerate(owners[at : at + 8]):
                for i in some:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            new.append(h("".join(run)))
            new_owners.append([i for some in owners[at : at + 8] for i in some])
        hashes, owners = new, new_owners
    return hashes[0], steps


def by_brute_force(rows, tampered):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for name in names:
        some = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        below[name] = some, *climbed([leaf(r, r["text"]) for r in some])
    root, top_steps = climbed([below[name][1] for name in names])
    out = []
    for name, upper in zip(names, top_steps):
        some, subroot, steps = below[name]
        for row, own in zip(some, steps):
            path = own + upper
            digest = leaf(row, tampered(row))
            for left, right in path:
                digest = h(left + digest + right)
            proof = h("".join(left + right for left, right in path))
            out.append((row["doc_id"], leaf(row, row["text"]), subroot, root, proof, digest, digest == root))
    return sorted(out, key=str)


def check(spark, docs):
    changed = merkle.manifest(docs, {"text": F.lower("text")}, F.col("doc_id") % 2 == 0)
    even = lambda r: r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["text"] is not None
    want = by_brute_force(docs.collect(), lambda r: r["text"].lower() if even(r) else r["text"])
    got = changed.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == want
    return {r["verified"] for r in got}


def test_odd_rows(spark):
    docs = documents(spark)
    assert check(spark, docs) == {True, False}
    assert check(spark, docs.where("doc_id = 4")) == {True}
    assert merkle.manifest(docs.limit(0)).count() == 0
    assert merkle.manifest(docs).where("NOT verified").count() == 0


def test_trees_of_all_sizes(spark):
    rng = random.Random(5)
    sizes = {None: 9, "": 1, "a": 8, "b": 7, "ab": 64, "é": 65, "z": 130, "Z": 2, "~": 521, "c1": 1, "c2": 3}
    rows = [(lang, i) for lang, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    rows = [(k if rng.random() > 0.02 else None, f"Text {i % 50} of {lang}", "s", lang) for k, (lang, i) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.char_length("text"))).repartition(7)
    check(spark, docs)
