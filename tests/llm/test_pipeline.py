from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.compare import multiset, spark_rows
from tests.conftest import data_dir
from tests.llm.odd import documents, groups_by_brute_force
from wardflow.llm import mixing, queries, secret_scan


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, data_dir("0.001"))
    result = duck(data_dir("0.001")).execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert spark_rows(found) == multiset(columns, result.fetchall())


def test_every_operator_has_a_query():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in contract.queries()


def test_stages_one_by_one(spark):
    folder = data_dir("0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.trained(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        out, before = stage(spark, docs, folder), docs.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        after = out.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "toxicity":
            scores = dict(zip(texts, model.scores(list(texts.values()))))
            assert {r["doc_id"] for r in after} == {i for i, s in scores.items() if s < 0.3}
        elif name == "near_duplicates":
            groups = groups_by_brute_force(texts.items())
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in groups.values()})
        elif name == "secrets":
            assert {r["doc_id"]: r["text"] for r in after} == {i: secret_scan.redacted_text(t) for i, t in texts.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).select("doc_id", "copies").collect()}
            assert Counter(r["doc_id"] for r in after) == Counter({i: c for i, c in copies.items() if c})
        else:
            assert len(after) == len(before) and all(r["decodes"] for r in after)
            assert all(r["n_tokens"] == len(r["ids"]) / 4 for r in after)
        docs = spark.createDataFrame(after, out.schema) if name != "byte_bpe" else docs


def test_stages_take_odd_rows(spark, tmp_path):
    folder = data_dir("0.001")
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = str(tmp_path / stage.__name__)
        out.write.parquet(path)
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = spark.read.parquet(path)
    assert docs.where("NOT decodes").count() == 0


def test_repeated_ids_lose_no_text_and_keep_no_copy(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [
        (1, text("a"), "s"),
        (2, text("a"), "s"),  # a copy of 1
        (2, text("b"), "s"),  # and alone
        (3, text("c"), "t"),  # three times the same
        (3, text("c"), "s"),
        (3, text("c"), None),
        (4, text("d"), "s"),  # the smallest of one group, and a copy of 1 besides
        (4, text("a"), "s"),
        (5, text("d"), "s"),
        (6, text("e") + " x", "s"),  # near copies of one another
        (6, text("e") + " y", "s"),
        (None, text("a"), "s"),
        (None, text("a"), "s"),
        (7, None, "s"),
        (7, None, "s"),
        (8, text("f"), "s"),
    ]
    docs = documents(spark, rows)
    out = corpus_pipeline.without_copies(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in out.collect())
    assert got == Counter([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (6, "e"), (None, "a"), (None, "a"), (7, ""), (8, "f")])
