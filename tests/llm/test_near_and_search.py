import random

import numpy as np
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from tests.llm.odd import documents, groups_by_brute_force
from wardflow.llm import components, minhash, topk


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    least = {i: i for e in edges for i in e if i is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: c for i, c in least.items() if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_of_near_copies(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for base in range(12):
        words = [f"{base}x{rng.randint(0, 10**6)}" for _ in range(rng.choice([4, 5, 30, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = f"y{rng.randint(0, 10**6)}"
            rows.append(((n := n + 1), " ".join(changed), "s"))
    # a chain whose ends are not alike
    chain = [f"c{i}" for i in range(80)]
    for i in range(30):
        rows.append(((n := n + 1), " ".join(chain[i : i + 50]), "s"))
    # many texts that share a long passage and little else
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [((n := n + 1), f"{shared} " + " ".join(f"q{i}r{j}" for j in range(28)), "s") for i in range(60)]
    rng.shuffle(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicate_groups(documents(spark, rows)).collect()}
    assert found == groups_by_brute_force([r[:2] for r in rows])


def test_odd_documents(spark):
    docs = documents(spark)
    out = minhash.near_duplicate_groups(docs).collect()
    assert len(out) == docs.count()
    want = groups_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_cover_trees_bound_their_points():
    points = np.floor(np.random.default_rng(1).normal(0, 60, (700, 6)))
    points[:90] = points[0]

    def check(node):
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius * (1 + 1e-9)
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert all(c.radius <= node.radius / 2 * (1 + 1e-9) for c in node.children)
            for c in node.children:
                check(c)

    check(topk.cover_tree(points))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    kinds = rng.normal(0, 0.4, (6, 5))
    rows = [(i, (kinds[i % 6] + rng.normal(0, 0.1, 5)).tolist()) for i in range(600)]
    rows += [(i, rows[7][1]) for i in range(600, 700)]  # equal vectors
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0]), (702, [float("nan")] * 5), (750, [float("inf")] * 5), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(0))
    used = {i: np.floor(np.asarray(v, np.float32).astype(float) * 256) for i, v in rows[:700]}
    want = set()
    for q in (i for i in used if i % 50 == 0):
        best = sorted(((-int(used[q] @ v), i) for i, v in used.items() if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    for points in (40, 5000):
        got = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, 5, points).collect()}
        assert got == want
    few = table.where("vec_id IN (0, 1, 50)")
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 4
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_below_zero_are_not_passed_over(spark):
    # a floor that a block's only point just reaches
    search = topk.Search(np.array([[-1000.0]]), 1, np.array([-1e6]))
    search.walk(np.array([[1000.0]]))
    assert [x.tolist() for x in search.results()] == [[0], [0], [-1e6]]
    # one component: every product of a point with another sign is negative
    values = [-100.0] + [100.0 + i for i in range(40)] + [100.0 + i for i in range(40)]
    table = spark.createDataFrame([(i if i else 1000, [v]) for i, v in enumerate(values)], "vec_id long, embedding array<float>")
    want = sorted((-int(256 * -100 * 256 * v), i) for i, v in enumerate(values) if i)[:5]
    for points in (1, 8, 5000):
        got = topk.top_k(table, F.col("vec_id") == 1000, 5, points).collect()
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def best_by_brute_force(rows, asks, k=5):
    """``query_id, rank, vec_id, score`` of rows with distinct ids."""
    used = {i: np.floor(np.asarray(v, np.float32).astype(float) * 256) for i, v in rows}
    want = set()
    for q in filter(asks, used):
        best = sorted(((-int(used[q] @ v), i) for i, v in used.items() if i != q))[:k]
        want |= {(q, place, i, -s) for place, (s, i) in enumerate(best, 1)}
    return want


def test_queries_meet_blocks_in_small_batches(spark, monkeypatch):
    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, value1, value2):
            return max(value1, value2)

    largest, kind = spark.sparkContext.accumulator(0, Largest()), type(spark.range(1))

    def watched(method):
        def run(self, f, *rest, **more):
            def counted(batches):
                for batch in f(batches):
                    largest.add(len(batch))
                    yield batch

            return method(self, counted, *rest, **more)

        return run

    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(kind, name, watched(getattr(kind, name)))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(1)
    got = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 2 == 0, 5, 2).collect()}
    assert got == best_by_brute_force(rows, lambda i: i % 2 == 0)
    assert 0 < largest.value <= 10_000


def test_a_query_keeps_no_more_than_its_places():
    # all products of a zero vector are equal
    search = topk.Search(np.zeros((3, 4)), 6, np.array([-np.inf, 0.0, 1.0]))
    search.walk(np.floor(np.random.default_rng(6).normal(0, 60, (5000, 4))))
    q, x, score = search.results()
    assert q.tolist() == [0] * 6 + [1] * 6 and x.tolist() == [*range(6)] * 2 and not score.any()


def test_blocks_larger_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_BYTES", 4 * 3 * 70)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 0.05, 3) + (1 if i % 2 else -3, 2, 0)).tolist()) for i in range(500)]
    rows += [(i, [0.0] * 3) for i in range(500, 530)]  # products that are all equal
    rows += [(i, (rng.normal(0, 300, 3)).tolist()) for i in range(530, 600)]  # wider integers
    rows += [(i, rows[i - 600][1]) for i in range(600, 900)]  # equal vectors
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for points in (30, 5000):
        got = {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 5 == 0, 5, points).collect()}
        assert got == best_by_brute_force(rows, lambda i: i % 5 == 0)


def test_points_as_16_bit_integers():
    rng = np.random.default_rng(8)
    for most in (160, 2**15):  # products that 32-bit floats hold, and larger ones
        points = rng.integers(-most, most, (3000, 64)).astype(np.int16)
        search = topk.Search(points[:40].astype(np.float32), 6, np.full(40, -np.inf))
        search.walk(points)
        scores = points[:40].astype(np.int64) @ points.T.astype(np.int64)
        want = [sorted(zip(-row, range(3000), strict=True))[:6] for row in scores]
        q, x, score = search.results()
        assert q.tolist() == [i for i in range(40) for _ in range(6)]
        assert list(zip((-score).tolist(), x.tolist(), strict=True)) == [pair for row in want for pair in row]


def test_results_are_shuffled_once(spark):
    found = spark.createDataFrame([(i % 3, i, i) for i in range(30)] * 2, "query_id long, vec_id long, score long")
    best = topk._ranked(found, 5)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r["rank"] for r in best.collect()) == [k for k in range(1, 6) for _ in range(3)]
