import random

import pytest

from tests.llm.odd import documents, words
from wardflow.llm import mixing


def filled(sizes, weights, share, epochs):
    """Clamp and share again until no source is above its cap."""
    left, target = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, w in enumerate(weights) if w]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = epochs * sizes[i]
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in over]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_follow_the_iteration(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 100, 1000, 90_000]) for _ in range(9)]
    weights = [rng.choice([None, 0.5, 1.0, 3.0, 40.0]) for _ in range(9)]
    frame = spark.createDataFrame(
        [(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double"
    )
    for share in (0.3, 1.5, 9.0):
        got = {r["source"]: r["target"] for r in mixing.water_filled(frame, share, 2).collect()}
        for i, want in enumerate(filled(sizes, weights, share, 2)):
            assert got[f"s{i}"] == pytest.approx(want), (share, i)


def test_sources_come_near_their_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    found = mixing.mixed(documents(spark, rows)).select("doc_id", "source", "size", "target", "source_size", "copies").collect()
    again = mixing.mixed(documents(spark, rows).repartition(7)).select("doc_id", "copies").collect()
    assert sorted((r["doc_id"], r["copies"]) for r in found) == sorted(map(tuple, again))
    for source in ("a", "b", "c", None):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 40
        assert {r["copies"] for r in own} <= {0, 1, 2}
        assert own[0]["source_size"] == sum(r["size"] for r in own)


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    found = mixing.mixed(docs)
    assert found.count() == docs.count()
    assert {(r["doc_id"], r["size"]) for r in found.select("doc_id", "size").collect()} == {
        (r["doc_id"], len(words(r["text"]))) for r in docs.collect()
    }
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.repeated(docs).count() == sum(r["copies"] for r in found.select("copies").collect())
    assert mixing.mixed(docs.limit(0)).count() == 0
